import random
import threading
from pathlib import Path

from filigree.llm import neardup as N


def meeting_by_chance(n=1200, seed=7):
    """Texts of their own words with a few stock phrases out of many each, and an edited copy of every tenth."""
    r = random.Random(seed)
    stock = [[f"s{i}w{j}" for j in range(9)] for i in range(40)]
    rows = []
    for k in range(n):
        w = [f"own{r.randrange(400_000)}" for _ in range(130)]
        for phrase in r.sample(stock, 5):
            at = r.randrange(len(w))
            w[at:at] = phrase
        rows.append((f"t{k}", " ".join(w)))
        if k % 10 == 0:
            for at in r.sample(range(len(w)), 4):
                w[at] = "edited"
            rows.append((f"e{k}", " ".join(w)))
    return rows


def test_disk_stays_in_proportion_to_the_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "SLICE", 500_000, raising=False)
    rows = meeting_by_chance()
    spark.createDataFrame(rows, "id string, text string").repartition(4).write.parquet(str(tmp_path / "texts"))
    df = spark.read.parquet(str(tmp_path / "texts"))
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = spark.sparkContext._jsc.sc().getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path / "shared"))
    roots = [tmp_path / "shared", *[Path(d.getPath()) for d in blocks.localDirs()]]

    def held():
        total = 0
        for p in (p for root in roots for p in root.rglob("*")):
            try:
                total += p.stat().st_size if p.is_file() else 0
            except OSError:
                pass
        return total

    floor, peak, over = held(), [0], threading.Event()

    def watch():
        while not over.wait(0.1):
            peak[0] = max(peak[0], held() - floor)

    watching = threading.Thread(target=watch)
    watching.start()
    try:
        got = {tuple(x) for x in N.near_duplicate_pairs(df, "id", "text", 3, 0.6, 40).collect()}
    finally:
        over.set()
        watching.join()
        if before.isDefined():
            spark.sparkContext._jsc.sc().setCheckpointDir(before.get())
    size = sum(p.stat().st_size for p in (tmp_path / "texts").glob("*.parquet"))
    assert got == {(f"e{k}", f"t{k}") for k in range(0, 1200, 10)}
    assert max(peak[0], held() - floor) <= 4 * size
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_bitmaps_differ_in_no_more_bits_than_the_sets(spark):
    r = random.Random(3)
    edges = [-(1 << 63) + k * (1 << 60) + d for k in range(16) for d in (-1, 0, 1) if k or d >= 0]
    sets = [sorted({r.getrandbits(64) - (1 << 63) for _ in range(m)} | set(r.sample(edges, min(m, 9)))) for m in (0, 1, 5, 60, 300, 2000)]
    df = spark.createDataFrame([(s,) for s in sets], "g array<bigint>").select("g", N.starts_in(N.F.col("g")).alias("m")).select("g", N.bitmap(N.F.col("m")).alias("bits"))
    for s, row in zip(sets, df.collect()):
        want = {(g + (1 << 63)) >> 54 for g in s}
        bits = [b & ((1 << 64) - 1) for b in row["bits"]]
        assert {64 * k + i for k, b in enumerate(bits) for i in range(64) if b >> i & 1} == want


def test_slices_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(N, "SLICE", 40_000, raising=False)
    monkeypatch.setattr(N, "HOT", 20)
    monkeypatch.setattr(N, "BLOCK", 8)
    w = [[f"{c}{i}" for i in range(60)] for c in range(10)]
    rows = [(f"k{c}-{e}", " ".join([*x[:e], "new", *x[e:]])) for c, x in enumerate(w) for e in range(0, 60, 2)]
    df = spark.createDataFrame(rows, "id string, text string").repartition(3)
    got = [tuple(x) for x in N.near_duplicate_pairs(df, "id", "text", 3, 0.6, 40).collect()]
    keys = sorted(k for k, _ in rows)
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in keys for b in keys if a < b and a[:2] == b[:2]}


def test_a_key_delivered_with_two_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [("k", a), ("k", b), ("x", a + " more"), ("y", b + " more")]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {tuple(x) for x in N.near_duplicate_pairs(df, "id", "text", 3, 0.6, 40).collect()}
    assert len(got) == 1 and got <= {("k", "x"), ("k", "y")}
