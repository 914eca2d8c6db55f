"""Feature groups: functions ``(snapshots, ctx) -> snapshots`` kept in a registry."""

from .registry import GROUPS, build, feature_group  # noqa: F401
from . import groups  # noqa: F401,E402
