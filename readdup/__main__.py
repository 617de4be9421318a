from readdup.cli import main

raise SystemExit(main())
