"""Command line: python -m granary <command>."""

import sys

from granary.cli import main

sys.exit(main())
