"""The corpus pipeline against a plain version of each stage and of the whole."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as P
from seguelab.llm import bpe, mixing, pii, quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
STOP = set(quality_rules.STOP_WORDS)


# --- plain versions ----------------------------------------------------------


def plain_good(text):
    """The threshold table by plain Python."""
    text = text or ""
    w, lines = re.findall(r"[^ \t\n\r]+", text), [x for x in text.split("\n") if x]
    n, share = len(w), lambda a, b: round(a / b, 6) if b else 0.0
    m = {
        "n_words": n,
        "mean_word_length": share(sum(map(len, w)), n),
        "symbol_ratio": share(sum(c in quality_rules.SYMBOLS for c in text), len(text)),
        "alpha_word_ratio": share(sum(any(c.isalpha() for c in x) for x in w), n),
        "upper_word_ratio": share(sum(x == x.upper() and x != x.lower() for x in w), n),
        "stop_word_ratio": share(sum(x.lower().rstrip(".,;:!?") in STOP for x in w), n),
        "repeat_ratio": share(sum(a == b for a, b in zip(w, w[1:], strict=False)), n),
        "repeated_line_ratio": share(len(lines) - len(set(lines)), len(lines)),
        "bullet_line_ratio": share(sum(x[0] in "-*•" for x in lines), len(lines)),
        "ellipsis_line_ratio": share(sum(x.endswith(("...", "…")) for x in lines), len(lines)),
    }
    return not any(n >= from_words and ((lo is not None and m[k] < lo) or (hi is not None and m[k] > hi)) for _, k, lo, hi, from_words in quality_rules.THRESHOLDS)


def shingles(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[k : k + 3]) for k in range(max(len(w) - 2, 1))} if w else set()


def plain_dedup(rows):
    """Exact Jaccard; the texts of these tests have pairs of 0.6 and more, and of 0.2 and less."""
    root = {}
    keyed = [(r["doc_id"], shingles(r["text"])) for r in rows if r["doc_id"] is not None]
    for i, _ in keyed:
        root[i] = i
    moved = True
    while moved:
        moved = False
        for i, a in keyed:
            for j, b in keyed:
                near = i == j or (a and b and len(a & b) / len(a | b) >= 0.45)
                if near and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    moved = True
    kept, out = defaultdict(list), [r for r in rows if r["doc_id"] is None]
    for r in rows:
        if r["doc_id"] is not None and root[r["doc_id"]] == r["doc_id"]:
            kept[r["doc_id"]].append(r)
    return out + [min(v, key=lambda r: (r["text"] is not None, r["text"] or "")) for v in kept.values()]


def plain_redact(rows):
    out = []
    for r in rows:
        text = r["text"]
        if text is not None:
            for a, b, kind in reversed(pii.find_spans(text)):
                text = text[:a] + f"[{kind.upper()}]" + text[b:]
        out.append(r | {"text": text, "n_chars": None if text is None else len(text)})
    return out


def plain_mix(rows, weights=None, budget=None):
    tokens = Counter()
    for r in rows:
        tokens[r["source"]] += len(re.findall(r"[^ \t\n\r]+", r["text"] or ""))
    weight = {s: (1.0 if weights is None else weights.get(s, 0.0)) if n else 0.0 for s, n in tokens.items()}
    goal, whole, out = float(sum(tokens.values()) if budget is None else budget), sum(weight.values()), []
    for r in rows:
        n = tokens[r["source"]]
        rate = weight[r["source"]] / whole * goal / n if n and whole else 0.0
        key = "null" if r["doc_id"] is None else str(r["doc_id"])
        draw = int(hashlib.md5(f"{mixing.SEED}:{key}".encode()).hexdigest()[:13], 16) / 2**52
        out += [r] * (int(rate) + (draw < rate - int(rate)))
    return out


def plain_tokens(rows):
    import tiktoken

    coder = tiktoken.Encoding("plain", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})
    return [{"doc_id": r["doc_id"], "lang": r["lang"], "source": r["source"], "tokens": None if r["text"] is None else coder.encode_ordinary(r["text"])} for r in rows]


PLAIN = {"quality_rules": lambda rows: [r for r in rows if plain_good(r["text"])], "minhash_near_dedup": plain_dedup, "pii": plain_redact, "mixing": plain_mix, "bpe": plain_tokens}


# --- tables ------------------------------------------------------------------


def documents():
    rng = np.random.default_rng(12)
    stop = "the and of to in is that for with on".split()
    words = [f"{a}{b}{c}" for a in "kltmn" for b in ("ara", "eli", "oru", "ime") for c in ("na", "to", "ris", "vel", "dom")]
    texts = []
    for _ in range(22):
        texts.append(" ".join(str(rng.choice(stop)) if rng.random() < 0.3 else str(rng.choice(words)) + str(rng.integers(0, 99)) for _ in range(90)) + ".")
    rows = [(k, t, "en", "web" if k % 3 else "book") for k, t in enumerate(texts)]
    near = texts[3].split()
    near[40] = "changed"
    rows += [(30, texts[0], "en", "web"), (31, texts[0].upper(), "en", "web"), (32, " ".join(near), "de", None), (33, texts[5] + " write jane (at) example (dot) com", "fr", "book")]
    rows += [(40, texts[7] + " call +1 (555) 123-4567", "en", "wiki"), (41, "### $$$ ### $$$", "en", "web"), (42, None, "en", "web"), (43, "", None, "web"), (44, "go " * 20, "en", "web")]
    rows += [(None, texts[9] + " x", "en", "wiki"), (None, texts[9] + " x", "en", "wiki"), (1, texts[1], "en", "web"), (2, texts[10] + " again", "en", None)]
    return [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), (*r, len(r[1] or "")), strict=True)) for r in rows]


def table(spark, rows, schema=DOCS):
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema)


def shown(rows, names):
    return sorted((tuple(tuple(v) if isinstance(v := r[c], list) else v for c in names) for r in rows), key=str)


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_each_stage(spark, name):
    rows = documents()
    out = dict(P.STAGES)[name](spark, table(spark, rows).repartition(3), "")
    names = [c for c in out.columns if c not in ("n_tokens", "round_trip")]
    got = [r.asDict() for r in out.collect()]
    assert shown(got, names) == shown(PLAIN[name](rows), names)
    if name == "bpe":
        assert all(r["round_trip"] if r["tokens"] is not None else r["round_trip"] is None for r in got) and all(r["n_tokens"] == len(r["tokens"] or []) for r in got)
    else:
        assert out.columns == [c.split()[0] for c in DOCS.split(", ")]


def test_the_whole(spark, tmp_path):
    rows = documents()
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.asDict() for r in P.run(spark, str(tmp_path)).collect()]
    want = rows
    for name, _ in P.STAGES:
        want = PLAIN[name](want)
    names = ["doc_id", "lang", "source", "tokens"]
    assert shown(got, names) == shown(want, names)
    kept = {r["doc_id"] for r in got}
    assert not kept & {30, 31, 32, 33, 41, 42, 43, 44}


def test_other_columns_and_empty_tables(spark):
    extra = "rank int, gone string, copy_no int, mix_rate double, quality string, keep_0 int"
    rows = [r | {"rank": 1, "gone": None, "copy_no": 2, "mix_rate": 0.5, "quality": "q", "keep_0": 3} for r in documents()[:6]]
    df = table(spark, rows, f"{DOCS}, {extra}")
    for name, stage in P.STAGES:
        out = stage(spark, df, "")
        assert (out.columns == df.columns or name == "bpe") and out.count() > 0
        assert stage(spark, df.limit(0), "").count() == 0
    small = df.select("doc_id", "text", "source")
    assert P.run_on(spark, small).columns == ["doc_id", "source", "n_tokens", "tokens", "round_trip"]


@pytest.mark.parametrize("weights, budget", [({"web": 3, "book": 1.0, None: 0.5}, 4000), ({"wiki": 1.0}, None), (None, 900)])
def test_target_weights(spark, weights, budget):
    rows = documents()
    got = [r.asDict() for r in mixing.mix_sources(table(spark, rows), weights, budget).collect()]
    names = ["doc_id", "text", "source"]
    assert shown(got, names) == shown(plain_mix(rows, weights, budget), names)
