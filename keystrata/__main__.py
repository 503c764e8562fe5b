"""python -m keystrata ROOT: the shell."""

from .cli import main

main()
