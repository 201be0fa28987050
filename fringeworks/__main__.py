import sys

from fringeworks.cli import main

sys.exit(main())
