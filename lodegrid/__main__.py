import sys

from lodegrid.cli import main

sys.exit(main())
