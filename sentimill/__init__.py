"""Review sentiment analytics on PySpark."""

from . import schemas  # noqa: F401
from .functions import *  # noqa: F401,F403
from .operators import *  # noqa: F401,F403
from .plans import *  # noqa: F401,F403
from .sources import *  # noqa: F401,F403
from .streaming import *  # noqa: F401,F403
