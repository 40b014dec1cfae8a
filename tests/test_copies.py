"""Copy plans against a target, next to a loop that looks at one file after the other."""

import random
from hashlib import md5

import pytest

from albumloom.operators import naming

FILES = "folder string, name string, src string, size bigint, md5 string"


def looped(files, target, numbered):
    there = {(f, n): (s, m) for f, n, s, m in target}
    for f, n, src, s, m in sorted(files, key=lambda r: r[2]):  # names that are wanted as such go first
        there.setdefault((f, n), (s, m, src))
    taken, out = dict(there), {}
    same = lambda a, b: a[0] is not None and a[1] is not None and a[:2] == b[:2]
    stem = lambda n, tail: n.rpartition(".")[0] + tail + "." + n.rpartition(".")[2]
    for f, n, src, s, m in sorted(files, key=lambda r: r[2]):
        me, held = (s, m), there[f, n]
        alt = stem(n, "_" + md5(src.encode()).hexdigest()[:8])
        if held[2:] == (src,):
            out[src] = (n, "copied")
        elif same(me, held):
            out[src] = (n, "exists_same")
        elif (f, alt) not in taken:
            taken[f, alt] = me
            out[src] = (alt, "copied_hashed")
        elif same(me, taken[f, alt]):
            out[src] = (alt, "exists_same")
        elif not numbered:
            out[src] = (alt, "conflict")
        else:
            equal = [k for k in range(2, 60) if (f, stem(alt, f"_{k}")) in there and same(me, there[f, stem(alt, f"_{k}")])]
            k = equal[0] if equal else next(k for k in range(2, 99) if (f, stem(alt, f"_{k}")) not in taken)
            taken.setdefault((f, stem(alt, f"_{k}")), me)
            out[src] = (stem(alt, f"_{k}"), "exists_same" if equal else "copied_hashed")
    return out


def case(seed):
    rng = random.Random(seed)
    content = lambda: (rng.choice([1, 2, None]), rng.choice(["x", "y", None]))
    files = [(rng.choice("fg"), f"IMG_{rng.randrange(4)}.jpg", f"/in/{i}/a.jpg", *content()) for i in range(60)]
    target = {(f, n): content() for f, n, *_ in files if rng.random() < 0.03}
    for f, n, src, s, m in files:
        alt = f"{n[:-4]}_{md5(src.encode()).hexdigest()[:8]}"
        if rng.random() < 0.7:
            target[f, f"{alt}.jpg"] = (s, m) if rng.random() < 0.2 else content()
            target |= {(f, f"{alt}_{k}.jpg"): content() for k in (1, 2, 3, 4, 6, 7) if rng.random() < 0.5}
    return files, [(f, n, s, m) for (f, n), (s, m) in target.items()]


@pytest.mark.parametrize("seed, numbered", [(1, True), (2, True), (3, False)])
def test_plan_equals_loop(spark, seed, numbered):
    files, target = case(seed)
    df, there = spark.createDataFrame(files, FILES), spark.createDataFrame(target, "folder string, name string, size bigint, md5 string")
    plan = naming.plan_copies(df, target=there, numbered=numbered)
    got = {r["src"]: (r["final_name"], r["status"]) for r in plan.collect()}
    want = looped(files, target, numbered)
    assert got == want and {s for _, s in want.values()} >= {"copied", "copied_hashed", "exists_same"} | (set() if numbered else {"conflict"})
    copied = [(r["folder"], r["final_name"]) for r in plan.collect() if r["status"] in ("copied", "copied_hashed")]
    assert len(copied) == len(set(copied)) and not {(f, n) for f, n, *_ in target} & set(copied)
    # what can be read is not copied by a second run
    again = naming.plan_copies(df.where("size IS NOT NULL AND md5 IS NOT NULL"), target=naming.listing(plan, there), numbered=numbered)
    assert {r["status"] for r in again.collect()} <= {"exists_same"} | (set() if numbered else {"conflict"})


def test_empty(spark):
    none = spark.createDataFrame([], FILES)
    assert naming.plan_copies(none).collect() == [] and naming.plan_copies(none, target=none.drop("src")).collect() == []


def test_hot_name(spark):
    """One name that a third of all files want."""
    files = [("f", "a.jpg" if i % 3 == 0 else f"{i}.jpg", f"/in/{i}", 1, str(i % 30)) for i in range(900)]
    got = naming.plan_copies(spark.createDataFrame(files, FILES), target=spark.createDataFrame([], FILES).drop("src")).collect()
    assert {r["src"]: (r["final_name"], r["status"]) for r in got} == looped(files, [], True)
