"""Every query of the league operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from pennant.plans.queries_core import CORE
from pennant.plans.queries_events import EVENTS
from pennant.plans.queries_models import MODELS
from pennant.plans.queries_more import MORE
from pennant.plans.queries_race import RACE
from pennant.plans.queries_recap import RECAP
from pennant.plans.queries_rows import ROWS
from pennant.plans.queries_scalars import SCALARS

_ALL = CORE | MODELS | RACE | ROWS | MORE | EVENTS | RECAP | SCALARS

QUERIES = {name: q for name, (q, _) in _ALL.items()}
ORACLES = {name: o for name, (_, o) in _ALL.items() if o}
