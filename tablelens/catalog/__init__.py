
from . import profiling  # noqa: F401
from . import cleaning  # noqa: F401
from . import charts  # noqa: F401
from . import htests  # noqa: F401
from . import sources  # noqa: F401
from . import edge  # noqa: F401
