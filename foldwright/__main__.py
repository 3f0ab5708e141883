from foldwright.cli import main

raise SystemExit(main())
