import sys

from docfold.cli import main

sys.exit(main())
