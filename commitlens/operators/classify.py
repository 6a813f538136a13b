"""Two-step classification of slices through an injected classifier, with retries, spacing and resumption."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import verdicts
from ..functions.labels import SAME, has_new

# Malware types by letter stand for the classes an analyst assigns.
TYPES = "ABCDEFGHIJKLM"


class Classifier(Protocol):
    def first(self, code: str) -> str:
        """JSON text with Detected Category."""

    def second(self, code: str) -> str:
        """JSON text with Classification; asked only where the first step says Malicious."""


class OfflineRules:
    """A deterministic stand-in that calls nothing: categories by what the code holds."""

    SOURCES = ("requests.get", "urlopen", "socket.", "os.environ", "getpass", "input(")
    SINKS = ("exec(", "eval(", "os.system", "subprocess", "ctypes")

    def first(self, code: str) -> str:
        sink, source = any(s in code for s in self.SINKS), any(s in code for s in self.SOURCES)
        category = "Malicious" if sink and source else "Undetermined" if sink else "Benign"
        return json.dumps({"Detected Category": category, "Malware Type": "Type A" if category == "Malicious" else None, "Stage": 1})

    def second(self, code: str) -> str:
        full = sum(code.count(s) for s in self.SINKS) > 1
        return json.dumps({"Classification": "Full Attack Chain" if full else "Core Attack Chain", "Malware_Type": "Type A", "Stage": 2})


def _asked(ask: Callable[[str], str], code: str, tries: int, wait: Callable[[], None]) -> dict:
    """The first answer that is a JSON object; errors of the connection are raised."""
    raw = ""
    for _ in range(tries):
        wait()
        raw = ask(code)
        try:
            got = json.loads(raw)
        except ValueError:
            continue
        if isinstance(got, dict):
            return got
    return {"error": "invalid_json", "raw_response": raw}


def classified(slices: DataFrame, make: Callable[[], Classifier] = OfflineRules, tries: int = 3, per_minute: float | None = None, partitions: int | None = None) -> DataFrame:
    """slices (with text) and body, the answer in JSON. Each task keeps its share of the rate, which is the whole rate over the partitions."""
    if partitions:
        slices = slices.repartition(partitions)
    gap = 60.0 / per_minute * (partitions or 1) if per_minute else 0.0
    if per_minute and not partitions:
        slices = slices.repartition(1)

    def run(batches):
        model, last = make(), [0.0]

        def wait():
            if gap:
                time.sleep(max(0.0, last[0] + gap - time.monotonic()))
                last[0] = time.monotonic()

        for pdf in batches:
            bodies = []
            for code in pdf["text"]:
                one = _asked(model.first, code or "", tries, wait)
                if one.get("Detected Category") == "Malicious":
                    one = one | _asked(model.second, code or "", tries, wait)
                bodies.append(json.dumps(one, ensure_ascii=False))
            yield pdf.assign(body=pd.Series(bodies, index=pdf.index, dtype=object))

    return slices.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in slices.dtypes) + ", body string")


def label_rows(slices: DataFrame, cached: DataFrame, make: Callable[[], Classifier] = OfflineRules, **how) -> DataFrame:
    """Rows of slice labels for slices (repo_name, commit_num, commit, code_slice, text): a cached answer (with body) is used again; new slices are classified; others are SAME AS BEFORE. The truth starts as the prediction."""
    keys = ["repo_name", "commit_num", "commit", "code_slice"]
    known = slices.join(cached.select(*keys, "body").dropDuplicates(keys), keys)
    rest = slices.join(cached.select(*keys), keys, "left_anti")
    asked = classified(rest.where(has_new("code_slice")), make, **how)
    rows = known.unionByName(asked).select(*keys, verdicts.label("body").alias("prediction"), verdicts.kind("body").alias("malware_type"))
    same = rest.where(~has_new("code_slice")).select(*keys, F.lit(SAME).alias("prediction"), F.lit("").alias("malware_type"))
    out = rows.unionByName(same)
    return out.select(*keys, F.col("prediction").alias("ground_truth"), "prediction", "malware_type")
