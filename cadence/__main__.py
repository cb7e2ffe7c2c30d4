from cadence.plans.cli import main

raise SystemExit(main())
