from tidemark.cli import main

raise SystemExit(main())
