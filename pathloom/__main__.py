import sys

from pathloom.cli import main

sys.exit(main(sys.argv[1:]))
