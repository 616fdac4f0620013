"""All queries of the subpackage; importing this module registers them."""

from . import q_bench  # noqa: F401
from . import q_chat  # noqa: F401
from . import q_class  # noqa: F401
from . import q_diverge  # noqa: F401
from . import q_filters  # noqa: F401
from . import q_katz  # noqa: F401
from . import q_license  # noqa: F401
from . import q_near  # noqa: F401
from . import q_pack  # noqa: F401
from . import q_pii  # noqa: F401
from . import q_rules  # noqa: F401
from . import q_sub  # noqa: F401
from . import q_url  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
