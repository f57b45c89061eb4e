"""Paths that the core tests share (a name of its own: `conftest` is any folder's)."""

import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FIX = os.path.join(ROOT, "tests", "fixtures")
SF_SMALL = "/root/testdata/sf0.001"


def fixture_path(name):
    return os.path.join(FIX, name)
