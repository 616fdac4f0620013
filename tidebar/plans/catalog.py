"""All registered queries. Importing this module fills the registry; later modules use table expressions of earlier ones."""

from . import q_basic  # noqa: F401
from . import q_features  # noqa: F401
from . import q_panel  # noqa: F401
from . import q_events  # noqa: F401
from . import q_policy  # noqa: F401
from . import q_models  # noqa: F401
from . import q_stream  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
