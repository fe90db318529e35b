"""Column-name patterns (case-insensitive) and vocabularies."""

from __future__ import annotations

import re

# Name patterns.
ID = r"(\bid\b|_id$|^id_)"
DESIGN = r"(^rep[0-9]*$|^block$|^row$|^col(umn)?$|^range$|^plot(no)?$|^site$|^site[ ._]?name$|^trial[ ._]?site$|^env(ironment)?$|^trial(_?acronym)?$|^year$|^season$|^colrep$|^tos$)"
TREATMENT = r"(treatment|^variety|^cultivar|genotype|^trt|^dose$)"
OUTCOME = r"(^(grain[ ._]?)?yield([ ._].*)?$|^response$|^outcome$)"
PII = r"(contact|email|phone|address|gps|latitude|longitude|\blat\b|\blon\b|postcode|postal|^zip|ssn|dob|birthdate|password|secret|api[_-]?key|owner|farmer|operator|customer)"
COORDINATE_NAME = r"(gps|latitude|longitude|\blat\b|\blon(g)?\b|easting|northing|\butm\b|wgs ?84|decimal_?(lat|lon))"
LADDER_COORDINATE = r"^(row|col|column|range|plot|plotno|x|y)$"
LADDER_ENVIRONMENT = r"^(env|environment|site|loc|location|year|season|county|region|state|trial|site_?year|loc_?year)$"
ENV_RESERVED = r"^(rep[0-9]*|block|row|col|column|range|plot|plotno|trial|experiment|study|panel|population|cohort)$"
ENV_EXACT = r"^(env|environment)$"
ENV_PRECOMPOSED = r"^(site_?year|loc_?year|location_?year)$"
ENV_SITE = r"^(site|location|loc|county|region|field|farm|place|site[ ._]?name|trial[ ._]?site)$"
ENV_YEAR = r"^(year|yr|season|harvest_?year|cycle)$"
GROUPING = r"^(trial|experiment|study|panel|population|cohort)$"
INFO_TABLE = r"dictionar|read[ ._-]?me|notes|info|meta[ ._-]?data|code[ ._-]?book"
SPATIAL_ROW, SPATIAL_COL = r"^(row|range)$", r"^(col|column)$"

# Vocabularies.
ROLES = ("design", "treatment", "outcome", "covariate", "date", "id", "text", "other")
ACTIONS = ("keep", "scramble", "alias", "drop")
KINDS = ("factor", "character", "logical", "numeric", "integer", "date", "datetime", "other")
CATEGORICAL, NUMERIC, DATES = ("factor", "character", "logical"), ("numeric", "integer"), ("date", "datetime")


def matches(name: str, pattern: str) -> bool:
    return re.search(pattern, name, re.IGNORECASE) is not None
