from lumenfold.cli import main

raise SystemExit(main())
