"""Tests of the text operators; a package, so that its ``helpers`` and the analytics' ``conftest`` do not meet."""
