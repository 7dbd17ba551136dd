"""Imports every module that registers queries."""

from . import queries_basic  # noqa: F401
from . import queries_annotate  # noqa: F401
from . import queries_profile  # noqa: F401
from . import queries_memory  # noqa: F401
from . import queries_streaming  # noqa: F401
from . import queries_more  # noqa: F401
from . import queries_sources  # noqa: F401
from . import queries_evaluate  # noqa: F401
