"""``python -m tallyloom``."""

import sys

from .cli import main

sys.exit(main())
