"""Published structures for tests that need one, from a folder that the environment names."""

import glob
import os


def fixture(pattern: str) -> str:
    """The first file of that name below HELIXFRAME_FIXTURES, or an empty text."""
    folder = os.environ.get("HELIXFRAME_FIXTURES", "")
    found = sorted(glob.glob(f"{folder}/**/{pattern}", recursive=True)) if folder else []
    return found[0] if found else ""
