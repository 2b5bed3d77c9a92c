"""Every query of the library; importing this module registers them."""

from lumenyard.plans import analytics, observing, opportunities, projecting, streams, texts, verification
from lumenyard.plans.registry import ORACLES, QUERIES

MODULES = [analytics, observing, opportunities, projecting, streams, texts, verification]


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
