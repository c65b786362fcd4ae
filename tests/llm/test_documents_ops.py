"""Operators over documents against brute force on small tables with odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attnstrata.llm import byte_bpe, byte_cnn, jaccard_groups, language_crf, license_scan, pii_spans, quality_rules, template_leaks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, s long, part int, word string"


def documents(spark, texts, ids=None, langs=None):
    """Documents with extra columns whose names operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    langs = langs or [None] * len(texts)
    rows = [(i, t, l, None, None if t is None else len(t), 7, 1, "w") for i, t, l in zip(ids, texts, langs, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


VOCABULARY = [f"{a}{b}" for a in ("ka", "lo", "mi", "ren", "sto") for b in ("ba", "do", "fi", "gu", "ta", "pel", "nor")]
ODD = [None, "", " \n\t ", "one", "One two", "x " * 30000, "\x00 \x1c", "émigré " * 12]


# n-gram Jaccard join

def shingle_set(text):
    found = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(found) < 3:
        return frozenset([tuple(found)] if found else [])
    return frozenset(zip(found, found[1:], found[2:], strict=False))


def brute_components(rows):
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 90 * len(a | b):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    return sorted(((i, len(shingle_set(t)), root(i) if i is not None else None) for i, t in rows), key=repr)


def family(rng, size, edits):
    base = [rng.choice(VOCABULARY) + str(rng.randrange(40)) for _ in range(size)]
    for _ in range(12):
        copy = list(base)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(size)] = f"new{rng.randrange(9999)}"
        yield " ".join(copy)


@pytest.mark.parametrize("small_groups", [False, True])
def test_jaccard_components_match_brute_force(spark, monkeypatch, small_groups):
    if small_groups:
        monkeypatch.setattr(jaccard_groups, "GROUP_SETS", 2)
        monkeypatch.setattr(jaccard_groups, "TASK_QUERIES", 2)
        monkeypatch.setattr(jaccard_groups, "PICK_ROWS", 0)
        monkeypatch.setattr(jaccard_groups, "PIECE_COUNT", 2)
    rng = random.Random(3)
    texts = [t for size in (9, 20, 40, 90, 200) for t in family(rng, size, 6)] + ODD
    texts += ["One two", "ONE  two", texts[0], texts[5].upper(), "same line here again"] * 2
    ids = [3 * k + 1 for k in range(len(texts))]
    ids[-1], ids[-2] = None, ids[4]  # a null id, and an id with two texts
    rows = list(zip(ids, texts, strict=True)) + [(ids[7], texts[7])]
    got = jaccard_groups.jaccard_components(documents(spark, [t for _, t in rows], [i for i, _ in rows]))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_components(rows)


def test_pairs_of_one_least_token_that_no_task_compares_at_first(spark, monkeypatch):
    """In a group dealt over several tasks, tokens that a set only asks with count if another set is their one owner."""
    monkeypatch.setattr(jaccard_groups, "TASK_QUERIES", 1)
    rng = random.Random(8)

    def made(text):
        tokens = jaccard_groups.distinct_sets(pa.array([text]), 3)[0]
        return tokens[0], jaccard_groups._signature(tokens)[0]

    texts = []
    while len(texts) < 180:
        base = [f"{rng.choice(VOCABULARY)}{rng.randrange(10**6)}" for _ in range(22)]
        long, short = " ".join(base), " ".join(base[:-2])  # 20 and 18 shingles: 90 percent
        if made(long)[0] != made(short)[0]:
            continue
        at = next(k for k in range(18) if made(" ".join(base[k : k + 3]))[0] == made(long)[0])
        for _ in range(2000):  # another set of that least token, which is the pivot
            other = " ".join([*base[at : at + 3], *(f"z{rng.randrange(10**6)}" for _ in range(2))])
            if made(other)[0] == made(long)[0] and made(other)[1] < min(made(long)[1], made(short)[1]):
                texts += [long, short, other]
                break
    got = jaccard_groups.jaccard_components(documents(spark, texts))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_components(list(enumerate(texts)))


def test_sets_of_a_lot_meet_other_lots_in_one_row(spark, monkeypatch):
    """Fifty sets of one lot share five tokens with a lot and nine with another: only the second is a candidate, of those that have them."""
    rows = [(s, 0, 100, [1, 2, 3, 4, 5, *range(20, 29 - s % 2 * 2)], 8, 1, 1) for s in range(50)]
    rows += [(60, 0, 100, [1, 2, 3, 4, 5, 70], 6, 2, 2), (61, 0, 100, list(range(20, 29)), 9, 3, 3), (62, 0, 10, list(range(20, 29)), 9, 4, 4)]
    groups = spark.createDataFrame(rows, "s long, doc_id long, n long, probe array<long>, entry int, own long, lot long").withColumn("done", F.col("lot"))
    askers = groups.where("s < 50")
    before = jaccard_groups._candidates(askers, groups, F.col("own") != F.col("done"), 80)
    wanted = sorted((r["s"], r["lot"]) for r in before.collect())
    assert wanted == [(s, 3) for s in range(0, 50, 2)]
    for limit in (1 << 12, 2):  # with a longer list of shared tokens than the limit, all of a fitting size are candidates
        monkeypatch.setattr(jaccard_groups, "LOT_TOKENS", limit)
        got = sorted((r["s"], r["lot"]) for r in jaccard_groups._candidates_of_lots(askers, groups, 80).collect())
        assert got == (wanted if limit > 2 else [(s, 3) for s in range(50)])


def test_a_token_of_many_small_pieces_is_counted():
    """Texts that come one by one give no piece with a token four times; a passage that all have is found common nevertheless."""
    rng = random.Random(4)
    texts = [" ".join([*(f"w{rng.randrange(10**9)}" for _ in range(6)), "the", "very", "same", "passage"]) for _ in range(1000)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array([i], pa.int64()), "text": pa.array([t])}) for i, t in enumerate(texts)]
    found = pa.Table.from_batches(jaccard_groups._describe(3)(iter(batches))).to_pydict()
    assert [d for d in found["doc_id"] if d is not None] == list(range(1000))
    times = {}
    for token, n in zip(found["token"], found["times"], strict=True):
        if token is not None:
            times[token] = times.get(token, 0) + n
    passage = {int(t) for t in jaccard_groups.distinct_sets(pa.array(["the very same passage"]), 3)[0].astype("int64")}
    assert set(sorted(times, key=times.get)[-2:]) == passage and 300 < min(times[t] for t in passage) < 3000


def test_unlinked_sets_of_a_group_ask_their_own_group_together(spark):
    """Sets of a group that was dealt over several tasks meet it by tokens that others of them have, not by what only they have."""
    ends = [range(10, 18), range(10, 18), range(30, 38), range(40, 48)]
    rows = [(s, s, 100, [1, 2, *end], 10, ~7, 7) for s, end in enumerate(ends)]
    rows += [(9, 9, 100, [*range(40, 48), 90], 9, 8, 8)]
    groups = spark.createDataFrame(rows, "s long, doc_id long, n long, probe array<long>, entry int, own long, lot long").withColumn("done", F.col("lot"))
    got = sorted((r["s"], r["lot"]) for r in jaccard_groups._candidates_of_lots(groups, groups, 80).collect())
    assert got == [(0, 7), (1, 7), (3, 8), (9, 7)]


def test_both_passes_meet_by_groups(spark, monkeypatch):
    def plain(*_):
        raise AssertionError("a row for each token, set and group")

    monkeypatch.setattr(jaccard_groups, "_candidates", plain)
    monkeypatch.setattr(jaccard_groups, "TASK_QUERIES", 2)
    monkeypatch.setattr(jaccard_groups, "GROUP_SETS", 2)
    rows = list(enumerate([t for size in (20, 60) for t in family(random.Random(size), size, 5)]))
    got = jaccard_groups.jaccard_components(documents(spark, [t for _, t in rows]))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_components(rows)


def test_keep_one_keeps_whole_rows(spark):
    docs = documents(spark, ["a b c d", "A b c d", None, "", "a b c d", "z"], [5, 2, 9, 10, 2, None])
    kept = jaccard_groups.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(
        [(2, "A b c d"), (9, None), (10, ""), (None, "z")], key=repr
    )


def test_jaccard_of_an_empty_table(spark):
    assert jaccard_groups.jaccard_components(documents(spark, [])).collect() == []


# byte-level BPE

@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_bpe_equals_tiktoken(spark, block_bytes):
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks()
    whole = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*ODD[:5], "x " * 300, "a  b\n\n c ", " lead", "don't we'll it's 12 345,6", "tab\tand\r\nline", "漢字 🙂 ok", "<|endoftext|> a", "a\u00a0b \u2003c", "émigré " * 5]
    docs = documents(spark, texts, [*range(len(texts) - 1), None])
    got = byte_bpe.decode(byte_bpe.encode(docs, ranks, block_bytes=block_bytes), ranks).collect()
    want = sorted((whole.encode_ordinary(t or ""), (t or "").encode()) for t in texts)
    assert sorted((list(r["ids"]), bytes(r["decoded"])) for r in got) == want
    query = {r["doc_id"]: r for r in byte_bpe.op3(docs).collect()}
    ids = whole.encode_ordinary(texts[8])
    assert query[8]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert query[0]["n_tokens"] == 0 and query[0]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()


def test_bpe_of_blank_runs_that_other_blanks_make_up_for(spark):
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks()
    top = max(ranks.values())  # the file has no token of several blanks, so wrong cuts between them would not show
    ranks |= {blanks: top + k for k, blanks in enumerate((b"  ", b"   ", b"\n ", b"\n  "), 1)}
    whole = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    blanks = ("\t", "\u00a0", "\r", "\r\n", "\f", "\u2003", "\x1c", "\x85")
    texts = [t.replace("_", b) for b in blanks for t in ("a_b_c   d", "x\n  b_c_d", "a_b_c_   d", "   a_b_c", "a_b_c   ", "a_b c d")]
    texts += ["if x:\r\n   y = 1\r\n", "k\tv\r\n   w\tz"]
    got = byte_bpe.encode(documents(spark, texts), ranks).collect()
    assert {texts[r["doc_id"]]: list(r["ids"]) for r in got} == {t: whole.encode_ordinary(t) for t in texts}


def test_bpe_of_an_empty_table(spark):
    assert byte_bpe.op3(documents(spark, [])).collect() == []


# quality rules

def brute_rules(text):
    text = text or ""
    found = words(text)
    grams = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    repeated = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_rules_match_brute_force(spark):
    rng = random.Random(9)
    texts = [None, "", " \n\t ", "one", "émigré " * 12, "a b c d e a b c d e f", "x\nx\n x\n\ny", "#*$%&|<> | a", "HOLD ON " * 9]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(25)] + [prose(rng, 150, VOCABULARY)]
    rows = {r["doc_id"]: r for r in quality_rules.op4(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        n, chars, symbols, lines, repeated = brute_rules(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeated), text
        assert r["base_failed"] == (n < 10 or 100 * repeated > 20 * n)
        assert not (r["base_failed"] and r["kept"])
    assert rows[len(texts) - 1]["kept"] and not rows[8]["kept"]


def test_ablations_count_from_the_ledger(spark):
    docs = documents(spark, ["word " * 12, "few words", "Fine prose of more than ten words stands here for all to see.", None])
    rows = quality_rules.ledger(docs)
    failures = [r["failures"] for r in rows.collect()]
    for r in quality_rules.ablations(rows).collect():
        bit, whole = quality_rules.RULES[r["rule"]][0], quality_rules.mask(r["version"])
        assert r["failed"] == sum(f & whole & bit > 0 for f in failures)
        assert r["failed_alone"] == sum(f & whole == bit for f in failures)
        assert r["kept"] == sum(f & whole == 0 for f in failures)
        assert r["kept_without"] == sum(f & whole & ~bit == 0 for f in failures)


# personal data

def brute_spans(text):
    out = []
    for kind, pattern in enumerate((
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    )):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (16 <= len(digits) <= 19 and pii_spans.luhn(digits)):
                continue
            if kind == 3 and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out)


def test_base_spans_match_the_patterns():
    rng = random.Random(5)
    pieces = ["a.b@c.d", "@", ".", "é", " ", "+", "1", "22", "333", "(", ")", "-", "x@y", "10.0.0.256", "4111111111111111", "+1 (555) 010-9999", "%", "0000010.1.2.3", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        assert sorted(pii_spans.base_spans(text)) == brute_spans(text), text


def test_pii_query_and_redaction(spark):
    rng = random.Random(1)
    texts = [None, "", "no data", "é mail a@b.example now", "ip 10.0.0.1 and 999.1.1.1", "card 4111 1111 1111 1111."]
    for k in range(60):
        texts.append(f"{prose(rng, 4, VOCABULARY)} +1 (555) 010-{1000 + k} {prose(rng, 3, VOCABULARY)} u{k}@mail.example and 10.1.{k}.2 or 4111111111111111 here")
    texts.append("ask +1 (555) 010-2000 4111111111111111 today")
    docs = documents(spark, texts)
    for r in pii_spans.op9(docs).collect():
        base = brute_spans(texts[r["doc_id"]])
        listed = ",".join(f"{pii_spans.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii_spans.BASE] == [sum(x[0] == i for x in base) for i in range(4)]
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))
        if r["doc_id"] == len(texts) - 1:  # the patterns take both numbers for one; the field parts them
            assert r["n_card"] == r["n_phone"] == 0 and r["spans"] == "card:22:38,phone:4:21"
    clean = pii_spans.redact(docs)
    assert clean.columns == docs.columns
    out = {r["doc_id"]: r for r in clean.collect()}
    assert out[0]["text"] is None and out[2]["text"] == "no data"
    assert out[3]["text"] == "é mail <EMAIL> now" and out[3]["n_chars"] == len(out[3]["text"])


# benchmark decontamination

ITEM = "A tank holds {n} litres and {who} drains it at {m} litres per hour until {n} litres are gone from it for good"


def test_leaks_find_copies_with_other_parameters(spark):
    rng = random.Random(4)
    plain = prose(rng, 30, VOCABULARY)
    bench = spark.createDataFrame(
        [(1, ITEM.format(n=90, m=5, who="Ann Lee")), (2, plain), (3, "too short"), (None, plain + " x"), (4, None), (2, plain)],
        "item_id long, text string",
    )
    fill = lambda: prose(rng, 20, VOCABULARY)
    texts = [
        f"{fill()}. {ITEM.format(n=90, m=5, who='Ann Lee')}. {fill()}",
        f"{fill()}. {ITEM.format(n='1,250', m=7, who='Bob')}. {fill()}",
        f"{fill()}. {ITEM.format(n=90, m=5, who='Ann').replace('90 litres are', '70 litres are')}. {fill()}",
        f"{fill()} {plain.upper().replace(' ', ' *** ')} {fill()}",
        fill(), None, "", plain[: len(plain) // 5], plain,
    ]
    ids = [*range(len(texts) - 1), None]
    docs = documents(spark, texts, ids)
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in template_leaks.leaks(docs, bench).collect()}
    assert got == {(0, 1): True, (1, 1): False, (2, 1): False, (3, 2): True}
    kept = template_leaks.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([4, 5, 6, 7, None], key=repr)
    assert template_leaks.leaks(docs, bench.limit(0)).collect() == []


# licence scans

def test_license_scan_matches_brute_containment(spark):
    rng = random.Random(8)
    texts = [None, "", "one two"]
    for k, (_, template) in enumerate(license_scan.TEMPLATES):
        texts += [f"{prose(rng, 7 + k, VOCABULARY)} {template} {prose(rng, 9, VOCABULARY)}", template.upper().replace(" ", "\n * ")]
        parts = template.split()
        if len(parts) > 20:
            texts += [" ".join([*parts[:-1], "other"]), " ".join(parts[: len(parts) // 2])]
    texts.append(prose(rng, 500, VOCABULARY))
    token = lambda t: re.findall(r"[0-9]+(?:[.,][0-9]+)*|[a-z0-9]+", (t or "").lower())
    grams = lambda t: {tuple(w[i : i + 5]) for w in [token(t)] for i in range(len(w) - 4)}
    numbers = lambda t: {w for w in token(t) if re.search("[0-9]", w)}
    want = {
        (i, k) for i, t in enumerate(texts) for k, (_, template) in enumerate(license_scan.TEMPLATES)
        if len(grams(t) & grams(template)) >= license_scan.CONTAINED * len(grams(template)) and numbers(template) <= numbers(t)
    }
    rows = license_scan.scan(documents(spark, texts)).collect()
    assert {(r["doc_id"], r["template"]) for r in rows} == want
    hit = next(r for r in rows if r["doc_id"] == 3)
    assert texts[3][hit["start"] : hit["end"]].lower() == "released under the mit license"


# learned models

def language_rows(rng, n):
    languages = {"aa": ["bor", "kel", "tum", "wes"], "bb": ["ñio", "éla", "oui", "ça"], "cc": ["xu", "zhi", "qo", "yeng"]}
    for k in range(n):
        lang = rng.choice(sorted(languages))
        yield k, lang, " ".join("".join(rng.choices(languages[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(6, 30)))


def test_language_crf_on_held_out_documents(spark):
    rng = random.Random(2)
    rows = list(language_rows(rng, 400))
    odd = [(1000, None, None), (1001, "aa", ""), (1002, None, "12 34 !!"), (1003, None, "bor kel tum\n" * 300), (None, "bb", "ñio éla")]
    docs = documents(spark, [t for *_, t in rows + odd], [i for i, *_ in rows + odd], [l for _, l, _ in rows + odd])
    got = {r["doc_id"]: r for r in language_crf.op1(docs).collect()}
    assert len(got) == len(rows) + len(odd)
    for i, *_ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    test = [(i, lang) for i, lang, _ in rows if got[i]["held_out"]]
    assert sum(got[i]["lang_pred"] == lang for i, lang in test) / len(test) > 0.97
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_words_of_mixed_text_are_labelled_one_by_one(spark):
    rng = random.Random(6)
    model = language_crf.fit([(lang, text) for _, lang, text in language_rows(rng, 400)])
    text = "bor kel borkel tum  ñio éla ouiéla\nxuzhi qo"
    row = language_crf.label_words(documents(spark, [text, None]), model).where("doc_id = 0").first()
    assert [text[w["start"] : w["end"]] for w in row["words"]] == text.split()
    assert [w["lang"] for w in row["words"]] == ["aa"] * 4 + ["bb"] * 3 + ["cc"] * 2


def test_without_labels_nothing_is_known(spark):
    docs = documents(spark, ["some text", None])
    assert {r["lang_pred"] for r in language_crf.op1(docs).collect()} == {"und"}
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in byte_cnn.op8(docs, labels).collect()} == {0.5}
    assert byte_cnn.op8(documents(spark, []), labels).collect() == []


def test_forward_backward_against_all_paths():
    import numpy as np

    rng = np.random.default_rng(0)
    score, switch = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    starts, sizes = np.array([0, 4]), np.array([4, 3])
    got, expected, log_z = language_crf.forward_backward(score, starts, sizes, switch, pairs=True)
    want, pairs, total = np.zeros((7, 3)), np.zeros((3, 3)), 0.0
    for start, size in zip(starts, sizes, strict=True):
        paths = list(itertools.product(range(3), repeat=int(size)))
        logs = np.array([sum(score[start + t, y] for t, y in enumerate(p)) + sum(switch[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths])
        z = np.logaddexp.reduce(logs)
        total += z
        for p, w in zip(paths, np.exp(logs - z), strict=True):
            for t, y in enumerate(p):
                want[start + t, y] += w
            for a, b in zip(p, p[1:], strict=False):
                pairs[a, b] += w
    assert np.allclose(got, want) and np.allclose(expected, pairs) and np.isclose(log_z, total)


def test_network_on_held_out_documents(spark):
    rng = random.Random(7)
    rows = []
    for k in range(360):
        good = rng.random() < 0.6
        text = prose(rng, rng.randrange(20, 300), VOCABULARY)
        rows.append((k, text if good else text.upper().replace(" ", "!! "), int(good)))
    docs = documents(spark, [t for _, t, _ in rows] + [None, ""], [i for i, *_ in rows] + [900, 901])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (5000, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in byte_cnn.op8(docs, labels).collect()}
    assert len(got) == 362 and got[900]["score"] == got[901]["score"]
    test = [(got[i], q) for i, _, q in rows if got[i]["held_out"]]
    assert sum(r["predicted"] == q for r, q in test) / len(test) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got.values())


def test_chunks_cover_every_byte():
    import pyarrow as pa

    texts = ["", None, "a" * 1024, "b" * 1025, "c" * 5000]
    rows, _, first = byte_cnn.chunks(pa.array(texts))
    for i, text in enumerate(texts):
        assert sum((rows[first[i] : first[i + 1]] > 0).any(axis=1)) == (len(range(0, max(1, len(text or "") - 128), 896)) if text else 0)
