import hashlib
import random

from pyspark.sql import functions as F

from intakespark.llm import line_dedup as L


def chunks(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out, own = [], []
    for i, x in enumerate(lines):
        own.append(x)
        if i == len(lines) - 1 or (h[i] * 31 + (h[i - 1] if i else 0)) % L.MODULUS == 0:
            out.append(own)
            own = []
    return out


def brute(rows):
    first = {}
    for i, t in sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is None, r[0] or 0)):
        for k, c in enumerate(chunks(t)):
            first.setdefault("\n".join(c), (i, t, k))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0, 0))
            continue
        all_ = chunks(t)
        fit = [len(c) >= L.LEAST_LINES and len("\n".join(c)) >= L.LEAST_CHARS for c in all_]
        kept = ["\n".join(c) for k, c in enumerate(all_) if not (fit[k] and first["\n".join(c)] != (i, t, k))]
        out.append((i, "\n".join(kept), sum(map(len, all_)), len(all_), len(all_) - len(kept)))
    return sorted(out, key=repr)


def got(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, chunk string, n_lines int")
    out = L.remove_repeated_chunks(df)
    assert out.columns == ["doc_id", "text", "chunk", "n_lines", "n_chunks", "n_removed"]
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_chunks, r.n_removed) for r in out.collect()), key=repr)


def test_against_plain_version(spark):
    rng = random.Random(1)
    line = lambda: " ".join(rng.choice("alpha beta gamma delta épsilon zeta".split()) for _ in range(rng.randint(1, 9)))
    shared = [[line() for _ in range(12)] for _ in range(4)]
    rows = [(None, "only\nonce"), (1, None), (2, ""), (3, "\n\n\n"), (3, "\n\n\n"), (4, "no line feed"), (5, "\n".join(line() for _ in range(4000)))]
    for k in range(10, 60):
        own = [line() for _ in range(rng.randint(0, 15))]
        at = rng.randint(0, len(own))
        rows.append((k, "\n".join(own[:at] + rng.choice(shared) + own[at:])))
    rows += [(70, rows[-1][1]), (70, rows[-1][1]), (None, rows[-2][1])]
    assert got(spark, rows) == brute(rows)
    assert sum(r[4] for r in brute(rows)) > 30


def test_shift_resistant(spark):
    passage = [f"line {k} of a passage that documents share" for k in range(30)]
    rows = [(1, "\n".join(passage)), (2, "\n".join(["own first line", *passage])), (3, "\n".join([*passage[:15], "put in", *passage[15:]]))]
    out = {r[0]: r for r in got(spark, rows)}
    assert out[1][4] == 0 and out[2][4] >= 4 and out[3][4] >= 3
    assert "own first line" in out[2][1] and "put in" in out[3][1]


def test_chunks_join_to_text(spark):
    texts = ["", "a", "\n", "a\nb\nc\n", "x\r\ny\n\nz"] + ["\n".join(str(k) for k in range(n)) for n in range(2, 40)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", L.chunk_lines(F.col("t")).alias("c")).collect()
    for r in rows:
        assert "\n".join(c.chunk for c in r.c) == r.t
        assert [(c.lines, c.chunk) for c in r.c] == [(len(c), "\n".join(c)) for c in chunks(r.t)]


def test_empty(spark):
    assert got(spark, []) == []


def brute_runs(rows):
    """Rows (doc_id, text), doc_ids apart and in order, with the lines that ``remove_repeated_runs`` leaves."""
    pairs, singles, seen, out = set(), set(), set(), []
    for i, t in rows:
        lines = t.split("\n")
        gone, run = set(), []
        for k, x in enumerate(lines):
            if x in singles and len(x.split()) > L.LONG_WORDS:
                gone.add(k)
            singles.add(x)
        for k in range(len(lines)):
            p = tuple(lines[k : k + 2])
            again = len(p) == 2 and p in pairs
            pairs.add(p)
            if again:
                run = run + [k + 1] if run else [k, k + 1]
            else:
                if len("\n".join(lines[j] for j in run)) >= L.LEAST_CHARS:
                    gone |= set(run)
                run = []
        if any(x.strip() for x in lines) and all(x in seen for x in lines if x.strip()):
            gone = set(range(len(lines)))
        seen |= set(lines)
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else t, len(lines), len(gone)))
    return out


def got_runs(spark, rows):
    out = L.remove_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"))
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=repr)


def test_planted_passages_go_whole(spark):
    rng = random.Random(2)
    line = lambda n: " ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(10**6)) for _ in range(n))
    rows, want = [], {}
    for n in range(1, 11):
        for k in range(20):
            passage = [line(60 if n == 1 else 5) for _ in range(n)]
            a, b = [[line(5) for _ in range(rng.randint(1, 5))] for _ in range(4)], len(rows)
            rows += [(b, "\n".join(a[0] + passage + a[1])), (b + 1, "\n".join(a[2] + passage + a[3]))]
            want |= {b: rows[b][1], b + 1: "\n".join(a[2] + a[3])}
    assert {r[0]: r[1] for r in got_runs(spark, rows)} == want


def test_runs_against_plain_version(spark):
    rng = random.Random(3)
    shared = ["", "x", *(" ".join(rng.choice("alpha beta gamma épsilon".split()) for _ in range(rng.choice((1, 2, 8, 70)))) for _ in range(12))]
    rows = [(k, "\n".join(rng.choice(shared) if rng.random() < 0.6 else f"own {rng.random()}" for _ in range(rng.randint(1, 12)))) for k in range(300)]
    rows += [(300, "a\na\na\na\n" * 20), (301, rows[5][1]), (302, rows[6][1] + "\n"), (303, ""), (304, "\n\n"), (305, "")]
    assert got_runs(spark, rows) == sorted(brute_runs(rows), key=repr)
    lines = {x for _, t in rows for x in t.split("\n")}
    assert {x for r in got_runs(spark, rows) for x in r[1].split("\n")} >= lines - {""}


def test_runs_rows_alike_null_and_empty(spark):
    text = "one line of a text here\nanother line of the text here"
    assert got_runs(spark, [(None, text), (1, None), (2, text), (2, text)]) == sorted([(None, "", 2, 2), (1, None, 0, 0), (2, text, 2, 0), (2, text, 2, 0)], key=repr)
    assert got_runs(spark, []) == []
