import numpy as np

from datamill.llm import lattice


def brute(rows):
    """(vec_id, links, component) of each row, pair by pair."""
    ids = [r[0] for r in rows]
    good = [i for i, (_, v, label) in enumerate(rows) if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, comp = {i: 0 for i in range(len(rows))}, {i: i for i in range(len(rows))}
    pairs = []
    for a in good:
        for b in good:
            x, y = (np.array(rows[k][1], np.float64) for k in (a, b))
            if a != b and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                links[a] += 1
                pairs.append((a, b))
    for _ in rows:
        for a, b in pairs:
            comp[b] = min(comp[a], comp[b])
    least = {}
    for i in range(len(rows)):
        if ids[i] is not None:
            least[comp[i]] = min(ids[i], least.get(comp[i], ids[i]))
    return sorted(((ids[i], links[i], least.get(comp[i])) for i in range(len(rows))), key=repr)


def test_nearest_points():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 8)) * 2
    point = lattice.nearest_point(x)
    assert (np.abs(point * 2 - np.rint(point * 2)) < 1e-9).all() and (np.rint(point.sum(1)) % 2 == 0).all()
    for r in lattice.ROOTS:
        assert (((x - point) ** 2).sum(1) <= ((x - point - r) ** 2).sum(1) + 1e-9).all()


def test_links_match_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(90):
        base = np.random.default_rng(i % 12).standard_normal(32)
        v = base + rng.standard_normal(32) * rng.choice([0, 0.05, 0.12])
        rows.append((1000 - i, [float(np.float32(x)) for x in v], i % 2))
    rows += [(1, None, 0), (2, [0.0] * 32, 0), (3, [1.0, None] * 16, 0), (4, [float("nan")] * 32, 0), (5, rows[0][1], None), (6, rows[0][1], 0), (6, rows[0][1], 0), (7, [1.0, 2.0], 0), (8, [float("inf")] * 32, 0)]
    # Null vec_ids take part; one vec_id may stand for vectors that have nothing in common.
    rows += [(None, rows[3][1], rows[3][2]), (None, [0.5, 0.25], 9), (None, [0.5, 0.25], 9), (rows[0][0], [-x for x in rows[0][1]], 0), (9, [1.0] * 5, 0), (10, [1.0] * 5, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "7 as n_links")
    want = brute(rows)
    for cell in (4096, 5):
        got = lattice.near_duplicates(df, cell_rows=cell).collect()
        assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == want
        assert all(r["kept"] == (r["component_id"] is None or r["vec_id"] == r["component_id"]) for r in got)
    assert lattice.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_split_cells_count_each_link_once(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(32)
    rows = [(i, [float(x) for x in base + rng.standard_normal(32) * 0.08], 0) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = lattice.near_duplicates(df, cell_rows=9).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == brute(rows)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(600):
        u, w = rng.standard_normal((2, 64))
        u /= np.linalg.norm(u)
        w -= (w @ u) * u
        cos = rng.uniform(0.9801, 0.985)
        rows += [(2 * i, u.tolist(), 0), (2 * i + 1, (cos * u + np.sqrt(1 - cos * cos) * w / np.linalg.norm(w)).tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert lattice.near_duplicates(df).where("n_links = 1 and component_id = vec_id - vec_id % 2").count() >= 0.998 * len(rows)


def test_signatures_keep_every_link():
    rng = np.random.default_rng(7)
    for size in (3, 16, 40, 300):
        u = lattice.unit_vectors(rng.standard_normal((400, size)))
        w = rng.standard_normal((400, size))
        w = lattice.unit_vectors(w - (w * u).sum(1)[:, None] * u)
        v = 0.98 * u + np.sqrt(1 - 0.98**2) * w
        gap = lattice.signatures(u).astype(float) - lattice.signatures(v)
        assert ((gap * gap).sum(1) <= lattice.most_apart(0.98)).all()
