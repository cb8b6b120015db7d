"""Adapter queries against brute force: every version of every package is asked, prereleases too."""

import datetime as dt
import re

from releaselode.functions.fixed import ADAPTERS
from releaselode.plans.catalog import QUERIES

PRIORITIES = {"": "3-MEDIUM", "rc1": "1-URGENT", "b2": "2-HIGH"}


def landed(spark, folder):
    """{package: {version: smallest order}}, written as orders."""
    rows, out = [], {}
    for n in range(1, 121):
        package, end = n % 4 + 5, ["", "rc1", "b2", "", ""][n % 7 % 5]
        day = dt.datetime(1995 + n // 70, 1 + n // 10 % 3, 3)
        rows.append((n, package, "O", 1.0, day, PRIORITIES[end]))
        out.setdefault(f"pkg{package:02}", {}).setdefault(f"{day.year - 1990}.{day.month}.{n % 10}{end}", n)
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    return out


def test_every_version_of_every_package(spark, tmp_path):
    made = landed(spark, str(tmp_path))
    got = {(r.repo, r.version): r.text for r in QUERIES["adapter_whole"](spark, str(tmp_path)).collect()}
    for name, _, template, _, _ in ADAPTERS:
        if "{v}" in template:
            assert {k: t for k, t in got.items() if k[0].endswith(f"/{name}")} == {(f"{p}/{name}", v): f"Notes of {v}" for p, versions in made.items() for v, n in versions.items() if n % 5}
    assert {v for _, v in got if v.endswith(("rc1", "b2"))} and len({r.split("/")[0] for r, _ in got}) == len(made) == 4


def test_files_of_several_versions(spark, tmp_path):
    made = landed(spark, str(tmp_path))
    got = {(r.repo, r.version): (r.text, r.url) for r in QUERIES["adapter_whole"](spark, str(tmp_path)).collect()}
    want = {}
    for name, branches, template, mode, _ in ADAPTERS:
        path = lambda v, t=template: t.replace("{v}", v).replace("{maj}", v.split(".")[0]).replace("{min}", v.split(".")[1])
        for package, versions in made.items():
            for v in versions:
                for b in branches:
                    file = [w for w, n in sorted(versions.items()) if n % 5 and path(w) == path(v) and b == ("main" if n % 3 else "master")]
                    if mode == "file":
                        text = "\n\n".join(f"Notes of {w}" for w in file)
                    elif mode == "section":
                        text = next((f"- Added {w}" for w in file if re.search(rf"(^|[^0-9]){re.escape(v)}([^0-9]|$)", w)), "")
                    else:
                        # a block of numbers and more, as 5.1.3b2, is read as 5.1.3 with the rest before the prose
                        hit = next((w for w in file if re.match(r"[\d.]+", w)[0] == v), "")
                        text = hit and (hit[len(v) :], f"Fixed {hit}")
                    if text:
                        anchor = "#" + v.replace(".", "") if name == "fastapi" else ""
                        want[f"{package}/{name}", v] = (text, f"https://github.com/{package}/{name}/blob/{b}/{path(v)}{anchor}")
                        break
    assert set(got) == set(want)
    for k, (text, url) in want.items():
        assert got[k][1] == url
        assert (got[k][0].startswith(text[0]) and got[k][0].endswith(text[1])) if isinstance(text, tuple) else got[k][0] == text
