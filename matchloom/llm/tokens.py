"""Token counts: huge texts are encoded as overlapping chunks and spliced where both sides agree."""

from __future__ import annotations

import functools
import json
import os

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.bpe import PIECES, byte_letters
from matchloom.llm.common import cut, text_key, text_of

#: Characters of a chunk, and of what two neighbours share at first.
CHUNK, OVERLAP = 1 << 16, 1 << 11
#: Characters whose encodings are held at a time, but for a longer text.
AT_ONCE = 1 << 19


@functools.lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The library's tokenizer, once for each worker; ``encode(texts) -> list of encodings or id lists``."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@functools.lru_cache(maxsize=2)
def same_by_rank(path: str) -> bool:
    """Whether merging by the ids of what arises gives the same ids as merging by the file's list of pairs.

    So it is where pieces are cut byte-level as usual, merges stand in order of the ids they make,
    every entry of two bytes and more is made by exactly one listed merge, and each entry's own
    bytes merge to it: then two neighbours whose bytes are an entry's are never anything but its pair.
    """
    if path.endswith(".model"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens") or []
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        return False
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return False
    texts = [t["content"] for t in added]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added) or any(a != b and a.startswith(b) for a in texts for b in texts):
        return False
    letters, vocab = byte_letters(), model["vocab"]
    if any(c not in letters for s in vocab for c in s if s not in texts) or any(c not in vocab for c in letters):
        return False
    merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    long = {i for s, i in vocab.items() if len(s) > 1 and s not in texts}
    if merged != sorted(set(merged)) or set(merged) != long:
        return False
    own = load_tokenizer(path).model
    return all([t.id for t in own.tokenize(s)] == [i] for s, i in vocab.items() if i in long)


@functools.lru_cache(maxsize=2)
def rank_encoder(path: str):
    """The rank-based library's encoder for a file of which :func:`same_by_rank` holds, several times faster."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, special = byte_letters(), {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
    ranks = {bytes(letters[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
    return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special)


def id_encoder(path: str, by_rank: bool):
    """text -> ids of the library for ``path``; ``by_rank`` is what :func:`same_by_rank` said of it."""
    if by_rank:
        encoding = rank_encoder(path)
        return lambda text: encoding.encode_to_numpy(text, allowed_special="all")
    if path.endswith(".model"):
        return load_tokenizer(path).encode
    return lambda text: load_tokenizer(path).encode(text, add_special_tokens=False).ids


def count_batch(path: str, texts: list[str], by_rank: bool = False) -> list[int]:
    """Tokens of each text; few characters are held as encodings at a time, as those take many times their text's memory."""
    if by_rank:
        encode = id_encoder(path, True)
        return [len(encode(t)) for t in texts]
    tok, out, at = load_tokenizer(path), [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= AT_ONCE):
            size += len(texts[end])
            end += 1
        part = texts[at:end]
        out += [len(ids) for ids in (tok.encode(part, num_threads=1) if path.endswith(".model") else tok.encode_batch_fast(part, add_special_tokens=False))]
        at = end
    return out


@functools.lru_cache(maxsize=4)
def lookahead(path: str) -> int | None:
    """Characters before a chunk's end in which a piece boundary isn't yet proven; None if none ever is.

    Byte-level pieces come from a left-to-right scan that starts anew at each piece and looks at
    most two characters past its end; added tokens are cut out first, so a cut one hides its whole
    length. With a normaliser, prefix space or space-eating added tokens this isn't so.
    """
    if path.endswith(".model"):
        return None
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec["model"]["type"] == "BPE"
    strict = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in added)
    texts = [t["content"] for t in added]
    apart = all(not a.endswith(b[:k]) for a in texts for b in texts for k in range(1, min(len(a), len(b)) + (a != b)) if k < len(a) or a != b)
    return 2 + max([0, *map(len, texts)]) if plain and strict and apart else None


def boundaries(path: str, text: str) -> tuple[list[int], list[int], int]:
    """Where pieces start, the tokens before each, and all tokens of one chunk."""
    enc = load_tokenizer(path).encode_batch([text], add_special_tokens=False)[0]
    at, before, last = [], [], object()
    for i, (word, (start, _)) in enumerate(zip(enc.word_ids, enc.offsets, strict=True)):
        if word != last:
            at.append(start)
            before.append(i)
            last = word
    return at, before, len(enc)


def _summaries(large: DataFrame, path: str, chunk: int, overlap: int, margin: int) -> DataFrame:
    """For each chunk: its tokens, and the piece boundaries of the stretches it shares with its neighbours."""

    def deal(batches):
        for batch in batches:
            for doc, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "__key", "__text")), strict=True):
                for i, start in enumerate(range(0, len(text), chunk)):
                    yield pa.RecordBatch.from_arrays([pa.array([doc], batch.column("doc_id").type), pa.array([key], pa.int64()), pa.array([i], pa.int32()), pa.array([start + chunk >= len(text)]), pa.array([text[start : start + chunk + overlap]])], names=["doc_id", "__key", "i", "end", "part"])

    def encode(batches):
        for batch in batches:
            rows = []
            for doc, key, i, end, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, before, total = boundaries(path, part)
                base, sure = i * chunk, len(part) + 1 if end else len(part) - margin
                pick = lambda lo, hi: [{"at": base + a, "n": n} for a, n in zip(at, before, strict=True) if lo <= a < hi and a <= sure]  # noqa: B023, E731
                rows.append({"doc_id": doc, "__key": key, "i": i, "end": end, "total": total, "head": pick(0, overlap), "tail": [] if end else pick(chunk, chunk + overlap)})
            marks = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", batch.column("doc_id").type), ("__key", pa.int64()), ("i", pa.int32()), ("end", pa.bool_()), ("total", pa.int64()), ("head", marks), ("tail", marks)]))

    kind = large.schema["doc_id"].dataType.simpleString()
    parts = large.mapInArrow(deal, f"doc_id {kind}, __key long, i int, end boolean, part string").repartition("doc_id", "__key", "i")
    return parts.mapInArrow(encode, f"doc_id {kind}, __key long, i int, end boolean, total long, head array<struct<at:long,n:long>>, tail array<struct<at:long,n:long>>")


def _splice(chunks: DataFrame) -> DataFrame:
    """Tokens of each text, null where two neighbours share no boundary.

    A boundary of both scans is stable: the left one is exact there and the scan from there on
    depends only on what follows, so tokens left of it come from the left chunk and the rest from the right.
    """
    order = Window.partitionBy("doc_id", "__key").orderBy("i")
    chunks = chunks.withColumn("left", F.lag("tail").over(order))
    common = F.array_min(F.array_intersect(F.transform("head", lambda x: x["at"]), F.transform("left", lambda x: x["at"])))
    chunks = chunks.withColumn("cut", F.when(F.col("i") == 0, F.lit(0).cast("long")).otherwise(common)).withColumn("next", F.lead("cut").over(order))
    at = lambda marks, p: F.get(F.filter(marks, lambda x: x["at"] == p), F.lit(0))["n"]
    first = F.when(F.col("i") == 0, F.lit(0).cast("long")).otherwise(at(F.col("head"), F.col("cut")))
    last = F.when(F.col("end"), F.col("total")).otherwise(at(F.col("tail"), F.col("next")))
    return chunks.groupBy("doc_id", "__key").agg(F.when(F.bool_and((last - first).isNotNull()), F.sum(last - first)).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``, as the library counts whole texts.

    A null text is empty and has no tokens; special strings in texts are handled as the library
    does by default; repeated rows are counted alike; other columns are ignored; an empty table
    gives no rows. Texts of at most ``chunk`` characters are encoded whole. Longer ones are cut
    into overlapping chunks, spread over the cluster and spliced; texts whose neighbours share no
    stable boundary are done again with overlaps and chunks four times as wide, until one chunk
    holds the text. Tokenizers for which no boundary is provable encode every text whole. Ids may be
    of any type. Byte-level files of which it is proven that ranks give the same ids are counted by
    the rank-based library.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("__text"))
    margin = lookahead(path)
    by_rank = same_by_rank(path)
    out = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"

    def whole(batches):
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            counts = count_batch(path, texts, by_rank)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    sized = rows.withColumn("n_bytes", F.octet_length("__text").cast("long"))
    small = sized if margin is None else sized.where(F.length("__text") <= chunk)
    done = small.select("doc_id", "n_bytes", "__text").mapInArrow(whole, out)
    if margin is not None:
        large = sized.where(F.length("__text") > chunk).withColumn("__key", text_key("__text"))
        keys = large.select("doc_id", "__key", "n_bytes")
        left, found, width, wide = large.select("doc_id", "__key", "__text").dropDuplicates(["doc_id", "__key"]), None, chunk, overlap
        while True:
            counted = cut(_splice(_summaries(left, path, width, wide, margin)))
            good = counted.where("n_tokens is not null")
            found = good if found is None else found.unionByName(good)
            bad = counted.where("n_tokens is null")
            if bad.isEmpty():
                break
            width, wide = 4 * width, 4 * wide
            bad = bad.select(F.col("doc_id").alias("d"), F.col("__key").alias("k"))
            left = left.join(bad, left["doc_id"].eqNullSafe(bad["d"]) & (left["__key"] == bad["k"]), "left_semi")
        found = found.select(F.col("doc_id").alias("d"), F.col("__key").alias("k"), "n_tokens")
        done = done.unionByName(keys.join(found, keys["doc_id"].eqNullSafe(found["d"]) & (keys["__key"] == found["k"])).select("doc_id", "n_bytes", "n_tokens"))
    return done.withColumn("over_limit", F.col("n_tokens") > limit)
