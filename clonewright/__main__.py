import sys

from clonewright.cli import main

sys.exit(main())
