"""Product codes against a plain Lloyd over whole arrays."""

import hashlib
import math

import numpy as np
import pytest

from lexiloom.llm import resident_lloyd

SCHEMA = "vec_id long, embedding array<float>, label int, code string, head string, pos string"


def table(spark, rows):
    return spark.createDataFrame([(i, x, y, "a", "b", "c") for i, x, y in rows], SCHEMA)


def plain(rows, parts, entries, rounds, scale=256):
    """(id, label, code, error, label error) of all kept rows and the codebooks' digest, by arrays in one place."""
    kept = [(i, [math.floor(float(np.float32(v)) * scale) for v in x], y) for i, x, y in rows
            if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = next((len(x) for _, x, _ in order if x and len(x) % parts == 0), parts)
    good, odd = [r for r in order if len(r[1]) == length], [r for r in order if len(r[1]) != length]
    w = length // parts
    x = np.array([r[1] for r in good], np.int64).reshape(len(good), parts, w)
    books = [x[:entries, p].copy() for p in range(parts)]

    def assign():
        d = [((x[:, p, None] - books[p][None]) ** 2).sum(2) for p in range(parts)]
        return np.stack([m.argmin(1) for m in d], 1), np.stack([m.min(1) for m in d], 1)

    for _ in range(rounds):
        at, _ = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                if (at[:, p] == e).any():
                    books[p][e] = x[at[:, p] == e, p].sum(0) // (at[:, p] == e).sum()
    at, far = assign() if good else (np.zeros((0, parts), int), np.zeros((0, parts), int))
    out = [(i, y, "".join(f"{e:02x}" for e in a), int(f.sum())) for (i, _, y), a, f in zip(good, at, far)]
    out += [(i, y, None, None) for i, _, y in odd]
    sums = {}
    for _, y, _, f in out:
        if f is not None:
            sums[y] = sums.get(y, 0) + f
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()
    return sorted(((i, y, c, f, sums.get(y)) for i, y, c, f in out), key=repr), digest


def found(df):
    rows = df.collect()
    return sorted(((r["vec_id"], r["label"], r["code"], r["error"], r["label_error"]) for r in rows), key=repr), {r["codebooks_sha256"] for r in rows}


@pytest.mark.parametrize("parts,entries,rounds", [(4, 8, 2), (2, 3, 3), (4, 64, 1)])
def test_equals_plain_lloyd(spark, parts, entries, rounds):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 8).round(2).tolist(), int(i % 3)) for i in range(300)]
    rows += [(900 + i, rows[7][1], None) for i in range(150)]  # a third are copies of one vector
    rows += [(7, rows[9][1], 1), (None, rows[3][1], 2), (None, None, 1), (1000, None, None), (1001, [1.0] * 7 + [None], 1),
             (1002, [float("nan")] + [0.0] * 7, 1), (1003, [float("inf")] * 8, 1), (1004, [], 5), (1005, [0.5] * 5, 1)]
    got, digest = found(resident_lloyd.compress(table(spark, rows), parts=parts, entries=entries, rounds=rounds))
    want, want_digest = plain(rows, parts, entries, rounds)
    assert got == want
    assert digest == {want_digest}


def test_ties_go_to_the_lower_entry_and_unused_entries_stay(spark):
    rows = [(0, [0.0, 0.0], 0), (1, [0.0, 0.0], 0), (2, [2 / 256, 2 / 256], 0), (3, [1 / 256, 1 / 256], 0)]
    got, digest = found(resident_lloyd.compress(table(spark, rows), parts=2, entries=3, rounds=1))
    want, want_digest = plain(rows, 2, 3, 1)
    assert got == want and digest == {want_digest}
    assert "01" not in "".join(c[i : i + 2] for _, _, c, _, _ in got for i in (0, 2))


def test_empty_and_too_large(spark):
    assert resident_lloyd.compress(table(spark, [])).collect() == []
    with pytest.raises(Exception, match="after scaling"):
        resident_lloyd.compress(table(spark, [(1, [1e30, 0.0], 0)]), parts=2).collect()


def test_owners_add_up_without_an_exchange_and_only_changed_parts_move(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 1, 8).tolist(), 0) for i in range(400)]
    kept = table(spark, rows)
    moved = []
    plain_settle = resident_lloyd._Members.settle

    def settle(self, members, mode="overwrite"):
        moved.append(members.count())
        if mode == "overwrite":
            plain_settle(self, members, mode)
            plan = resident_lloyd.owner_sums(self.rows(), 2)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning(pos") == 1, plan  # the owners' sums alone meet
        else:
            plain_settle(self, members, mode)

    resident_lloyd._Members.settle = settle
    try:
        resident_lloyd.compress(kept, parts=4, entries=8, rounds=3).collect()
    finally:
        resident_lloyd._Members.settle = plain_settle
    assert moved[0] == 1600 and all(0 < n < 800 for n in moved[1:]) and moved[2] < moved[1]
