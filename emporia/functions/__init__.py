"""Scalar column functions (inventory C1-C14)."""
from .scalars import *  # noqa: F401,F403
