import sys

from lexitally.cli import main

sys.exit(main())
