"""Every registered query of the text operators on the smallest tables, against plain loops or properties."""

import hashlib
import html
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from voxelgrain.llm import near_copies, queries
from voxelgrain.llm.report_language import gram_counts

from tests.llm.test_text_operators import literal_spans

FOLDER = "/root/testdata/sf0.001"


def column(table, *names):
    held = pq.read_table(f"{FOLDER}/{table}.parquet")
    return [held[n].to_pylist() for n in names]


@pytest.fixture(scope="module")
def texts():
    return dict(zip(*column("documents", "doc_id", "text"), strict=True))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def rows_of(spark, name):
    rows = queries.QUERIES[name](spark, FOLDER).collect()
    return {r[0]: r for r in rows}, rows


def digest(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_secret_scan(spark, texts):
    by_key, rows = rows_of(spark, "op1_secret_scan")
    assert sorted(by_key) == sorted(texts) and len(rows) == len(texts)
    for key, row in by_key.items():
        spans = literal_spans(texts[key] or "")
        listed = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        assert (row["spans"], row["base_sha256"]) == (listed, digest(listed))
        assert [row[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")]


def test_byte_pairs(spark, texts, library):
    by_key, rows = rows_of(spark, "op2_byte_pairs")
    assert len(rows) == len(texts)
    for key, row in by_key.items():
        ids = library.encode(texts[key] or "", add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == digest(np.array(ids, "<u4").tobytes())
        assert row["decoded_sha256"] == digest(library.decode(ids, skip_special_tokens=False))


def test_toxic(spark, texts):
    by_key, rows = rows_of(spark, "op3_toxic")
    assert sorted(by_key) == sorted(texts) and len(rows) == len(texts)
    for key, row in by_key.items():
        assert row["held_out"] == (zlib.crc32(str(key).encode()) % 5 == 0)
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.5)


def test_near_copies(spark, texts):
    by_key, rows = rows_of(spark, "op4_near_copies")
    prints = {k: near_copies.fingerprint(t) for k, t in texts.items()}
    least = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and least[b] < least[a]:
                    least[a], changed = least[b], True
    assert {k: (r["fingerprint"], r["component_id"]) for k, r in by_key.items()} == {k: (f"{prints[k]:016x}", least[k]) for k in prints}
    assert len(rows) == len(texts)


def test_conversations(spark):
    by_key, rows = rows_of(spark, "op5_conversation_tree")
    held = {}
    for conv, turn, role, text in zip(*column("conversations", "conv_id", "turn", "role", "text"), strict=True):
        held.setdefault(conv, []).append((turn, role, text or ""))
    said = "</s>[INST] ok [/INST]"
    held[-7] = [(0, "user", said), (1, "assistant", said)]
    assert sorted(by_key) == sorted(held) and len(rows) == len(held)
    for conv, turns in held.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        row = by_key[conv]
        assert (row["n_turns"], row["turns_sha256"]) == (len(turns), digest("".join(f"{role}\n{t}\n" for _, role, t in turns)))
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), digest(loss))
        assert row["formatted_chars"] >= sum(len(t) for _, _, t in turns)


def test_pages_keep_their_words(spark):
    by_key, rows = rows_of(spark, "op6_page_text")
    pages = dict(zip(*column("pages", "page_id", "html"), strict=True))
    assert len(rows) == len(pages)
    shown = 0
    for key, page in pages.items():
        page = page or ""
        body = re.sub(r"(?is)<!--.*?-->|<(script|style|template|noscript|title)\b.*?</\1>", " ", page)
        words = set(re.findall(r"\w+", html.unescape(re.sub(r"(?s)<[^>]*>", " ", body))))
        got = set(re.findall(r"\w+", by_key[key]["text"]))
        # list numbers and alternative texts are the only words that stand in no text of the page
        extra = {w for w in got - words if not w.isdigit() and w not in page}
        assert not extra, (key, extra)
        if not re.search(r"(?i)hidden|display\s*:\s*none|<select|<svg|<iframe|<object|<head", page):
            assert words <= got, (key, words - got)
            shown += 1
        assert by_key[key]["n_lines"] == len(by_key[key]["text"].split("\n"))
    assert shown or all(re.search("(?i)<head|hidden|none", p or "") for p in pages.values())


def overlap(words, own):
    """Best number of equal words over all alignments that pass the rule; 0 if none does."""
    if len(own) < 5:
        return len(own) if 0 < len(own) == len(words) and (words == own).all() else 0
    window = min(15, len(own))
    padded = np.concatenate([np.full(len(own), -1), words, np.full(len(own), -1)])
    best = 0
    for at in range(len(padded) - len(own) + 1):
        equal = padded[at : at + len(own)] == own
        sums = np.cumsum(np.append(0, equal))
        if 5 * (sums[window:] - sums[:-window]).max() >= 4 * window:
            best = max(best, int(equal.sum()))
    return best


def test_benchmark(spark, texts):
    _, rows = rows_of(spark, "op7_benchmark_overlap")
    numbers: dict[str, int] = {}

    def coded(text):
        return np.array([numbers.setdefault(w, len(numbers)) for w in re.findall(r"\w+", (text or "").lower())], np.int64)

    items = {i: coded(t) for i, t in zip(*column("benchmark", "item_id", "text"), strict=True)}
    want = {}
    for key, text in texts.items():
        words = coded(text)
        for item, own in items.items():
            if 2 * np.isin(own, words).sum() >= min(15, len(own)) and (count := overlap(words, own)):
                want[key, item] = count
    assert {(r["doc_id"], r["item_id"]): r["matching_words"] for r in rows} == want and len(rows) == len(want) > 0


def test_exact_copies(spark, texts):
    by_key, rows = rows_of(spark, "op8_exact_copies")
    groups = {}
    for key, text in texts.items():
        groups.setdefault("".join(c.lower() if c.isascii() else c for c in text or ""), []).append(key)
    for text, keys in groups.items():
        for key in keys:
            row = by_key[key]
            assert (row["keep_id"], row["group_size"], row["kept"], row["text_sha256"]) == (max(keys), len(keys), key == max(keys), digest(text))
    assert len(rows) == len(texts)


def test_token_store(spark, texts, library):
    by_key, rows = rows_of(spark, "op9_token_store")
    start = 0
    for key in sorted(texts):
        ids = [*library.encode(texts[key] or "", add_special_tokens=False).ids, 0]
        row = by_key[key]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(rows) == len(texts)


def test_language(spark, texts):
    by_key, rows = rows_of(spark, "op10_language")
    model = queries.language_model(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    langs = dict(zip(*column("documents", "doc_id", "lang"), strict=True))
    right = []
    for key, text in texts.items():
        row = by_key[key]
        assert row["held_out"] == (zlib.crc32(str(key).encode()) % 4 == 2)
        vector = np.sqrt(gram_counts([text], model.classes)[0]) * model.weights
        if not any(c.isalpha() for c in text or ""):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        likeness = [float(vector @ c) / np.linalg.norm(vector) for c in model.centroids]
        best = int(np.argmax(likeness))
        assert row["lang_pred"] == model.languages[model.owners[best]] and abs(row["score"] - min(likeness[best], 1)) < 1e-4
        if row["held_out"] and langs[key]:
            right.append(row["lang_pred"] == langs[key])
    assert len(rows) == len(texts) and np.mean(right) > 0.9
