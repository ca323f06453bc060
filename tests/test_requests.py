"""Batches of requests for jobs against a loop, and lists of contents against the fold over a paragraph."""

import random
from collections import Counter

import pytest

from quarry.operators import control, records, requests

SCHEMA = "request_id long, at long, file_hash string, file_type string, job_type string, provider string, cost double, confirm boolean, force boolean, completed_at long"


def loop(asked, jobs, cap):
    """Requests in order of time; what a request made completes at its time."""
    done = [(at, str(i), f) for i, f, kind, at in jobs if kind == "translate" and at is not None]
    out = {}
    for i, at, f, ft, kind, provider, cost, confirm, force, completed in sorted(asked, key=lambda r: (r[1], r[0])):
        reason = None
        if f is None:
            reason = "not_found"
        elif kind not in requests.JOB_TYPES:
            reason = "job_type"
        elif kind == "translate" and provider == "deepl" and ft.startswith("pdf"):
            reason = "provider"
        elif kind == "translate" and cost is not None and cost > cap and not confirm:
            reason = "cost"
        earlier = max(((a, j) for a, j, g in done if g == f and a <= at), default=None)
        if reason:
            out[i] = ("rejected", reason, None)
        elif kind == "translate" and not force and earlier:
            out[i] = ("duplicate", None, earlier[1])
        else:
            out[i] = ("created", None, f"r{i}")
            if kind == "translate" and completed is not None and completed >= at:
                done.append((completed, f"r{i}", f))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_requests_see_what_earlier_ones_did(spark, seed):
    rnd = random.Random(seed)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        asked = []
        for i in range(300):
            at = rnd.randrange(200)
            asked.append((i, at, rnd.choice(["hot", "hot", "a", "b", "c", None]), rnd.choice(["epub", "pdf_scan"]), rnd.choice(["translate"] * 5 + ["parse_only", "other", None]), rnd.choice(["openai", "deepl", None]), rnd.choice([1.0, 3.0, None]), rnd.choice([True, False, None]), rnd.choice([True, False, False, None]), rnd.choice([None, at, at + 5, at + 50, at - 1])))
        jobs = [(1, "a", "translate", 20), (2, "a", "translate", 3), (3, "b", "parse_only", 1), (4, "c", "translate", None), (5, None, "translate", 1)]
        got = requests.create_jobs(spark.createDataFrame(asked, SCHEMA), spark.createDataFrame(jobs, "job_id long, file_hash string, job_type string, completed_at long")).collect()
        assert {r["request_id"]: (r["result"], r["reason"], r["job"]) for r in got} == loop(asked, jobs, 2.0) and len(got) == 300
        assert len(Counter(r["result"] for r in got)) == 3
        rows = [("hot" if i % 3 else None, i, rnd.choice([None, rnd.randrange(1000)])) for i in range(500)]
        seen = control.latest_before(spark.createDataFrame(rows, "k string, i long, v long"), ["k"], ["i"], control.F.col("v"), "top").collect()
        for r in seen:
            assert r["top"] == max((v for k, i, v in rows if k == r["k"] and i <= r["i"] and v is not None), default=None)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_contents_are_split_as_by_the_fold(spark):
    rnd = random.Random(4)
    glyphs, want = [], {}
    for para in range(60):
        lines = []
        number = 1
        label = rnd.choice([None, "text", "Table ", "title"])
        for k in range(rnd.randrange(1, 9)):
            if k and rnd.random() < 0.1:
                lines.append(None)
                continue
            number += rnd.choice([0, 1, 5, -2] if para % 4 == 0 else [0, 1, 5])
            text = rnd.choice(["Bread", "Rye and oat", "x", "12", " "]) + rnd.choice(["", f" {max(number, 1)}", f" {max(number, 1)}", f" {max(number, 1)}", "12345"])
            left, x, line = rnd.choice([0.0, 0.0, 20.0, 7.0]), 0.0, []
            for ch in text:
                if ch != " ":
                    line.append((left + x, left + x + 5.0, ch, 10.0))
                x += 10.0
            lines.append(line or [(left, left + 1, " ", 10.0)])
        while lines and lines[-1] is None:
            lines.pop()
        if not lines:
            continue
        glyphs += [(para, label, k, *g) for k, line in enumerate(lines) for g in line or []]
        reason, cuts = records.contents_cuts(label, lines)
        want[para] = (reason, ",".join(map(str, cuts)))
    rnd.shuffle(glyphs)
    df = spark.createDataFrame(glyphs, "para long, label string, line int, x double, x2 double, ch string, size double")
    got = {r["para"]: (r["reason"], r["cuts"]) for r in records.split_contents(df).collect()}
    assert got == want and {"fired", "not_monotonic", "deny_layout", "low_fraction"} <= {r for r, _ in want.values()}
