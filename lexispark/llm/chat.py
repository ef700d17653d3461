r"""Chat formatting with loss masks from token offsets.

Turns are rendered as `<|im_start|>role\ntext<|im_end|>\n`. Inside roles and texts every `<` that backslashes and a bar may follow
gets one backslash more before the bar, so no control string occurs there and taking one backslash away gives the text back; roles
also have line breaks written as `\n` and backslashes doubled. The rendered conversation is encoded once; token spans are byte
offsets that tile it, turn spans are sorted, and binary search in the token offsets gives the tokens that each turn meets. The mask
holds for each assistant text its first and last token and the bytes of these that are not of the text, so it is exact where a token
crosses a border.

A conversation is handled as a stream of segments of whole turns: a line break stands between turns, the pattern breaks there, and
so the ids are those of the whole. A conversation of any length needs one segment's memory.

Null roles and texts count as empty; a null turn comes first; turns that repeat are turns of their own, in the order of role and
text; rows with a null conv_id form one conversation. An empty table has no rows.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_path, encoding, ranks
from .common import batch, map_arrow

START, END = "<|im_start|>", "<|im_end|>"
SEGMENT_CHARS = 1 << 18
_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + "([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), unescape(role))


@lru_cache(2)
def _lengths(path: str) -> np.ndarray:
    table = ranks(path)
    out = np.zeros(max(table.values()) + 1, "i8")
    for b, i in table.items():
        out[i] = len(b)
    return out


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of the turns and the byte spans of the assistant's texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        begin = at + len(head.encode())
        at = begin + len(body.encode())
        if role == "assistant":
            spans.append((begin, at))
        at += len(END) + 1
        out += [head, body, END, "\n"]
    return "".join(out), spans


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """For each span its first token, the one after its last, bytes of the first before it and of the last after it. offsets: where tokens begin, and the end."""
    if not spans:
        return np.zeros((0, 4), "<i8")
    begin, end = np.array(spans, "i8").T
    first = np.searchsorted(offsets, begin, "right") - 1
    last = np.maximum(np.searchsorted(offsets, end, "left"), first)
    return np.stack([first, last, begin - offsets[first], np.maximum(offsets[last] - end, 0)], 1).astype("<i8")


def format_turns(conversations: DataFrame, path: str | None = None, segment: int = SEGMENT_CHARS) -> DataFrame:
    """conv_id, segment, formatted, ids and mask (little-endian, see mask()) of each conversation's segments; those of one follow each other in one partition."""
    path = path or default_path()

    def run(batches):
        conv, k, turns, size, begun = None, 0, [], 0, False

        def out():
            text, spans = render(turns)
            ids = np.array(encoding(path).encode_ordinary(text), "<u4")
            offsets = np.concatenate([[0], np.cumsum(_lengths(path)[ids])])
            return batch(
                ["conv_id", "segment", "formatted", "ids", "mask"], [pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary()],
                [[conv], [k], [text], [ids.tobytes()], [mask(offsets, spans).tobytes()]],
            )

        for b in batches:
            for c, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if begun and (c != conv or size >= segment):
                    yield out()
                    k = k + 1 if c == conv else 0
                    turns, size = [], 0
                conv, begun = c, True
                turns.append((role, text))
                size += len(text)
        if turns:
            yield out()

    rows = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return map_arrow(dealt, run, "conv_id long, segment int, formatted string, ids binary, mask binary")


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a rendered text."""
    return [(unescape_role(m.group(1)), unescape(m.group(2))) for m in _TURN.finditer(formatted)]


def masked_texts(ids: np.ndarray, mask: np.ndarray, path: str | None = None) -> list[str]:
    """What the mask leaves of the ids, unescaped, span by span."""
    table = _bytes(path or default_path())
    out = []
    for first, last, before, after in mask.tolist():
        raw = b"".join([table[i] for i in ids[first:last].tolist()])
        out.append(unescape(raw[before : len(raw) - after].decode()))
    return out


@lru_cache(2)
def _bytes(path: str) -> dict[int, bytes]:
    return {i: b for b, i in ranks(path).items()}


def digests(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """One row per conversation, read back from the output of format_turns as it lies: its segments in order."""
    path = path or default_path()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        conv, all_turns, loss, n = None, None, None, [0, 0, 0]

        def out():
            return batch(names, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], [[x] for x in (conv, n[0], all_turns.hexdigest(), n[1], loss.hexdigest(), n[2])])

        for b in batches:
            for c, k, text, ids, m in zip(*(b.column(x).to_pylist() for x in ("conv_id", "segment", "formatted", "ids", "mask")), strict=True):
                if k == 0:
                    if all_turns is not None:
                        yield out()
                    conv, all_turns, loss, n = c, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                turns = parse(text)
                for role, said in turns:
                    all_turns.update(f"{role}\n{said}\n".encode())
                for said in masked_texts(np.frombuffer(ids, "<u4"), np.frombuffer(m, "<i8").reshape(-1, 4), path):
                    loss.update(said.encode())
                    n[1] += len(said)
                n[0] += len(turns)
                n[2] += len(text)
        if all_turns is not None:
            yield out()

    return map_arrow(formatted, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
