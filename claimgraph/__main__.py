import sys

from claimgraph.cli import main

sys.exit(main())
