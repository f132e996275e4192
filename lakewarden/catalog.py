"""All queries of the library by name, and the SQL that they are checked against."""

from __future__ import annotations

import lakewarden.functions.coercions
import lakewarden.functions.phrases
import lakewarden.functions.scalars
import lakewarden.operators.aggregations
import lakewarden.operators.calendars
import lakewarden.operators.hierarchy
import lakewarden.operators.joins
import lakewarden.operators.people
import lakewarden.operators.ranges
import lakewarden.operators.regulatory
import lakewarden.operators.reports
import lakewarden.operators.rules
import lakewarden.operators.screening
import lakewarden.operators.statements
import lakewarden.plans.drill
import lakewarden.plans.etl
import lakewarden.plans.imports
import lakewarden.plans.journals
import lakewarden.plans.loads
import lakewarden.plans.predicates
import lakewarden.plans.secure
import lakewarden.plans.snippets
import lakewarden.streaming.alerts  # noqa: F401  modules register their queries
from lakewarden.registry import ORACLES, QUERIES

FLAGSHIP = "risk_composite"


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
