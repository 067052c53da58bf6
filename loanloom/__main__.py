"""``python -m loanloom``."""

from loanloom.jobs import main

main()
