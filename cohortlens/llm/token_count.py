"""Token counts of whole texts by a public tokenizer file, in Arrow batches that return lengths only.

Texts are cut at safe boundaries into pieces of about ``PIECE_CHARS`` characters; the pieces of an Arrow batch are encoded
in groups of about ``GROUP_BYTES`` bytes, and only the number of ids of each is kept, so a task holds one Arrow batch and the ids of one group.

A boundary is safe where no token can cross it: before a single space, or between a letter and a digit, with ASCII letters or digits on
both sides. The pre-tokenizers used here always part the text there. A text without a safe boundary is encoded whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import clear_of, quoted

#: Characters from which a text is cut.
PIECE_CHARS = 1 << 16
#: UTF-8 bytes encoded at once.
GROUP_BYTES = 1 << 20
#: Tokens beyond which a document is over the limit.
LIMIT = 512
#: Longest run without white space for the fast encoder.
MAX_RUN = 1 << 12

# Fixed by the public tokenizer: how byte-level pre-tokenization parts a text.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?= [A-Za-z0-9])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
# Characters that both encoders class alike: assigned long ago, so not subject to the libraries' Unicode versions.
_PLAIN = re.compile(r"[\t\n\r -~¡-ɏͰ-ͳΑ-ΡΣ-ϿЀ-ҁ–—‘-”•…€]*\Z")


def _long_run(text: str) -> bool:
    """Whether a run without or of only white space is longer than MAX_RUN."""
    return len(text) > MAX_RUN and bool(_RUN.search(text))


_RUN = re.compile(rf"\S{{{MAX_RUN}}}|\s{{{MAX_RUN}}}")


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` cut at the first safe boundary after every ``size`` characters."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class _Tokenizers:
    """A ``.json`` file: the tokenizers library, and where it gives the same counts faster, its byte-level merges in tiktoken."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.cuttable = self._plain_byte_level(spec)
        self.fast = self._byte_level(spec) if self.cuttable else None

    @staticmethod
    def _plain_byte_level(spec: dict) -> bool:
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        return (
            model.get("type") == "BPE" and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and not any(re.search(r"[A-Za-z0-9] [A-Za-z0-9]|[A-Za-z][0-9]|[0-9][A-Za-z]", x["content"]) or x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec.get("added_tokens", []))
        )

    @staticmethod
    def _byte_level(spec: dict):
        """The same merges as ranks, if each merge makes the id that follows the one before it; else None."""
        import tiktoken

        # fixed by the format: printable bytes stand for themselves, the others for the code points from 256
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab.get(a + b) for a, b in merges]
        added = {x["content"] for x in spec.get("added_tokens", [])}
        tokens = {t: i for t, i in vocab.items() if t not in added}
        if made != list(range(256, 256 + len(merges))) or len(tokens) != 256 + len(merges):
            return None
        ranks = {bytes(byte_of[c] for c in t): i for t, i in tokens.items()}
        return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def lengths(self, texts: list[str]) -> list[int]:
        if self.fast is None:
            return [len(e) for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]
        out = [0] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if _PLAIN.match(text) and not any(x in text for x in self.added) and not _long_run(text):
                out[i] = len(self.fast.encode_ordinary(text))
            else:
                rest.append(i)
        for i, e in zip(rest, self.own.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = len(e)
        return out


class _Sentences:
    """A ``.model`` file: the sentencepiece library, whole texts."""

    cuttable = False

    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.own.encode(texts, num_threads=1)]


@functools.cache
def encoder(path: str) -> _Tokenizers | _Sentences:
    """The encoder of a file, made once per Python worker."""
    return _Sentences(path) if path.endswith(".model") else _Tokenizers(path)


def token_lengths(texts: list[str], path: str, piece_chars: int = PIECE_CHARS, group_bytes: int = GROUP_BYTES) -> list[int]:
    """Tokens of each text; pieces are encoded in groups of about ``group_bytes``."""
    model = encoder(path)
    totals = [0] * len(texts)
    group: list[str] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        for i, n in zip(owners, model.lengths(group)):
            totals[i] += n
        group.clear()
        owners.clear()

    for i, text in enumerate(texts):
        for piece in pieces(text, piece_chars) if model.cuttable else (text,):
            group.append(piece)
            owners.append(i)
            held += len(piece.encode("utf-8", "surrogatepass"))
            if held >= group_bytes:
                flush()
                held = 0
    flush()
    return totals


def count_tokens(docs: DataFrame, tokenizer_path: str, keep: list[str], text: str = "text", limit: int = LIMIT) -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_bytes, n_tokens and over_limit (n_tokens > ``limit``).

    ``tokenizer_path`` must be readable under the same name on every executor. A null text counts as empty: 0 bytes, 0 tokens.
    Every row gives one row. No begin, end or other special token is added; special strings inside a text are
    handled as the library does by default. Names of ``keep`` that clash with the new columns get the new ones underscores.
    """
    made = clear_of(keep, "n_bytes", "n_tokens", "over_limit", "__text")
    schema = ", ".join(f"`{c}` {t}" for c, t in [*docs.select(*quoted(keep)).dtypes, *zip(made, ("long", "long", "boolean"))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = token_lengths(batch.column(batch.num_columns - 1).to_pylist(), tokenizer_path)
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], *made[1:3]])

    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(*quoted(keep), F.octet_length(whole).cast("long").alias(made[0]), whole.alias(made[3])).mapInArrow(encode, schema)
