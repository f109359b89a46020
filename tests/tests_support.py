"""Random inputs shared by tests."""

from test_diff import history  # noqa: F401
from test_replay import LANDED, SCANS, stream  # noqa: F401
