"""Refusals and warnings that callers can catch by kind."""

from __future__ import annotations

import warnings


class Refusal(ValueError):
    """The engine declines to go on; kind says why, detail carries offending names or values."""

    kind = "refusal"

    def __init__(self, message: str, detail: object = None):
        super().__init__(message)
        self.detail = detail


class SurrogateWarning(UserWarning):
    """The engine goes on, but the caller should know."""

    kind = "warning"


def _kinds(base: type, names: str) -> dict[str, type]:
    return {n: type(n, (base,), {"kind": n, "__module__": __name__}) for n in names.split()}


globals().update(_kinds(Refusal, """
UnusedArgument BadTable BadConditional BadGrain BadLadder MissingPlan BadPlan BadQuiet BadAllowance BadAliasNames TooFewRows UnmaskedCoordinates CoordinateAction BadEvents
BadAnchors BadSeed DuplicateNames ModeConflict BadInfo BadLinks PlanMissingTable BadSheets InvalidEnvironment BlockedWrite AuditMissing BadOriginal UnmappedValue MissingColumn
IntegrityMismatch BadRecipeFile BadCard BadSet ExistingTarget BadSite
"""))  # fmt: skip
globals().update(_kinds(SurrogateWarning, """
ModeUnset ConditionalDegraded EventsPooled HighLeakage FewRows NameRepaired AmbiguousMerge GrainSmallUnits CoordinatesAllowed CoordinatesSuspected GeoUngrouped GeoConsolidated
GeoWideGroup GeoUnplaced GeoAnchorMissing AllKeep ModeDowngrade PlanModeMismatch EnvironmentDisclosure HighOverride InfoHint VersionNote
"""))  # fmt: skip


def warn(kind: type, message: str) -> None:
    warnings.warn(message, kind, stacklevel=3)
