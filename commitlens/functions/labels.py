"""Label columns: canonical names, severities, slice identities, malware types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label domain, in order of severity, and its aliases.
BENIGN, UNDETERMINED, CORE, FULL = "Benign", "Undetermined", "Core Attack Chain", "Full Attack Chain"
STATES = [BENIGN, UNDETERMINED, CORE, FULL]
CF = [CORE, FULL]
SAME = "SAME AS BEFORE"
MERGED = "Benign/Undetermined"
ABSENT = "Absent"
ALIASES = {"Benign Artifact": BENIGN, "Undetermined Call Chain": UNDETERMINED, "Fragmented Attack Chain": UNDETERMINED}
#: Names of the kinds of chains, and the pattern that each stands for.
CHAIN_KINDS = {
    "benign_or_undetermined_to_core_to_full": "B/U->C->F",
    "benign_or_undetermined_to_core": "B/U->C_or_F",
    "benign_or_undetermined_to_full": "B/U->C_or_F",
    "core_to_full_no_bu": "C->F",
    "full_then_core_no_bu": "F->C",
    "benign_or_undetermined_to_full_then_core": "B/U->F->C",
    "all_core": "ALL C",
    "all_full": "ALL F",
}
PATTERNS = ["B/U->C->F", "B/U->C_or_F", "C->F", "F->C", "B/U->F->C", "ALL C", "ALL F"]


def text(c) -> Column:
    """Trimmed text; a null is empty."""
    return F.trim(F.coalesce(_c(c), F.lit("")))


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical(c) -> Column:
    """A label by its own name: aliases resolved, unknown ones as they are."""
    x = text(c)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in ALIASES.items() for v in kv]), x), x)


def severity(c) -> Column:
    """0 to 3 for the states, -1 for Absent, 0 for the merged state; null for all else."""
    return F.when(_c(c) == ABSENT, -1).when(_c(c) == MERGED, 0).otherwise(F.nullif(F.array_position(F.array(*[F.lit(s) for s in STATES]), _c(c)), F.lit(0)) - 1).cast("int")


def state_of(sev) -> Column:
    return F.get(F.array(*[F.lit(s) for s in STATES]), _c(sev))


def is_valid(c) -> Column:
    return _c(c).isin(STATES)


def is_cf(c) -> Column:
    return _c(c).isin(CF)


def merged(c) -> Column:
    """Benign and Undetermined as one state."""
    return F.when(_c(c).isin(BENIGN, UNDETERMINED), MERGED).otherwise(_c(c))


def is_new(c) -> Column:
    return F.coalesce(_c(c), F.lit("")).startswith("NEW@")


def has_new(c) -> Column:
    """The looser test by which slices are classified anew."""
    return F.contains(F.coalesce(_c(c), F.lit("")), F.lit("NEW"))


def slice_id(c) -> Column:
    """The slice's name without one leading NEW@."""
    return F.regexp_replace(text(c), "^NEW@", "")


def slice_identity(c) -> Column:
    """Struct of slice_id, method and file_token: the name less _slice.py, cut at its first @."""
    own = slice_id(c)
    stem = F.regexp_replace(own, "_slice\\.py$", "")
    at = F.instr(stem, "@")
    return F.struct(own.alias("slice_id"), F.when(at > 0, F.substring(stem, F.lit(1), at - 1)).otherwise("").alias("method"), F.when(at > 0, F.substring(stem, at + 1, F.length(stem))).otherwise(stem).alias("file_token"))


def malware_type(c) -> Column:
    """The type, or empty for the ways of saying none."""
    x = text(c)
    return F.when(F.lower(x).isin("", "none", "null", "nan"), "").otherwise(x)


def type_letter(c) -> Column:
    """`Type X` from free text that names one; else the text."""
    x = text(c)
    letter = F.regexp_extract(x, r"(?i)\bType\s*([A-Z])\b", 1)
    return F.when(letter != "", F.concat(F.lit("Type "), F.upper(letter))).otherwise(x)


def comparison_state(c) -> Column:
    """A state from text that holds its name; null for blank text."""
    x = text(c)
    return F.when(x == "", None).when(x.contains("Full"), FULL).when(x.contains("Core"), CORE).when(x == MERGED, MERGED).when(x.contains(UNDETERMINED), UNDETERMINED).when(x.contains(BENIGN), BENIGN).otherwise(x)


def pattern(states, merge_bu: bool = False) -> Column:
    """The kind of a state sequence by where its core and full attack states stand; null without either.

    The merged state does not count as Benign or Undetermined unless merge_bu.
    """
    s = _c(states)
    soft = [BENIGN, UNDETERMINED, *([MERGED] if merge_bu else [])]
    core, full = F.array_position(s, CORE), F.array_position(s, FULL)
    bu = F.exists(s, lambda x: x.isin(soft))
    return (
        F.when((F.size(s) == 0) | (core + full == 0), None)
        .when((core > 0) & (full == 0), F.when(bu, "B/U->C_or_F").otherwise("ALL C"))
        .when((full > 0) & (core == 0), F.when(bu, "B/U->C_or_F").otherwise("ALL F"))
        .when(core < full, F.when(bu, "B/U->C->F").otherwise("C->F"))
        .otherwise(F.when(bu, "B/U->F->C").otherwise("F->C"))
    )


def kind_pattern(kind) -> Column:
    """The pattern that a kind of chains stands for; null for an unknown kind."""
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in CHAIN_KINDS.items() for v in kv]), text(kind))


def plot_state(c) -> Column:
    """A label by its own name, the merged state as it is; null for blank text."""
    return F.nullif(canonical(c), F.lit(""))
