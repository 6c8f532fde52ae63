import sys

from tarnwell.cli import main

sys.exit(main())
