"""Spelling variants: words one letter apart, found by PartEnum signatures.

A word is the vector of its letters with their copy numbers, one bit each. Words of equal
length with one letter replaced lie at Hamming distance two at most, words with one letter
more at distance one exactly. PartEnum turns such a bound into equal keys: the bits are
dealt to ``FIRST`` parts, one of which must take at most its share of the distance, and
each of these to ``SECOND`` smaller parts, of which all but that share must agree; every
choice of agreeing parts gives one signature. Two words within the bound have a signature
in common, always. Letters alone say little where a corpus has many words, so a signature
also holds the half of the word that the one edit leaves alone (its beginning if the edit
lies behind it, else its end) and the two lengths it is for. Signatures are equi-joined and
each pair is verified, so nothing depends on how well they select.

All work after counting is on distinct words: a word that makes up a third of the corpus is
one row. Counting runs in the JVM with partial sums before its one exchange.

Defined results: null texts hold no words; empty texts neither. A null ``doc_id`` counts as
an empty one. Documents that repeat an id are counted each. Of several near words of the
same count the first in code-point order is the form. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.llm.store import stored

LETTERS = r"A-Za-zÀ-ÿ"
ONE_IN = 31
LENGTH = 7
COUNT = 2
TIMES = 10
FIRST, SECOND = 2, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, length: int = LENGTH, count: int = COUNT, one_in: int = ONE_IN) -> DataFrame:
    """(word, n): runs of letters, some with a letter left out, that are long and frequent enough."""
    found = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{length},}}"), F.lit(0))
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run")
    ).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    code = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (code % F.char_length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    kept = F.when(code % one_in == 0, cut).otherwise(F.col("run"))
    return (
        runs.select(kept.alias("word")).where(F.char_length("word") >= length)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)
    )


def part_enum(word: str, distance: int, first: int, second: int) -> list[str]:
    """Signatures of the word's letters: any two words whose letters differ in at most
    ``distance`` places share one."""
    share = (distance + 1 + first - 1) // first - 1
    parts: list[list[list[str]]] = [[[] for _ in range(second)] for _ in range(first)]
    seen: dict[str, int] = {}
    for letter in sorted(word):
        copy = seen[letter] = seen.get(letter, 0) + 1
        bit = ord(letter) * 5 + copy * 3
        parts[bit % first][bit // first % second].append(f"{letter}{copy}")
    return [
        f"{p}:{','.join(map(str, chosen))}:" + "|".join("".join(part[c]) for c in chosen)
        for p, part in enumerate(parts)
        for chosen in combinations(range(second), second - share)
    ]


def signatures(word: str) -> list[tuple[bool, int]]:
    """(lengths differ, key): a near word has one of them too."""
    n, out = len(word), []
    replaced = part_enum(word, 2, FIRST, SECOND)
    shifted = part_enum(word, 1, FIRST, 1)
    # The lower of the two lengths decides where the halves meet.
    for other, kinds in ((n, replaced), (n - 1, shifted), (n + 1, shifted)):
        low = min(n, other)
        half = low // 2
        for side, text in (("<", word[:half]), (">", word[n - (low - half):])):
            head = f"{low}{'=' if other == n else '+'}{side}{text}/"
            out += [(other != n, xxhash.xxh64_intdigest(head + kind) - (1 << 63)) for kind in kinds]
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = batch.column("word").to_pylist()
        for begin in range(0, len(held), 2000):
            rows, differs, keys = [], [], []
            for i, word in enumerate(held[begin : begin + 2000], begin):
                own = set(signatures(word))
                rows += [i] * len(own)
                differs += [d for d, _ in own]
                keys += [k for _, k in own]
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("word").take(at), batch.column("n").take(at), pa.array(differs, pa.bool_()), pa.array(keys, pa.int64())],
                ["word", "n", "differs", "key"],
            )


def near_words(counted: DataFrame) -> DataFrame:
    """(word, n, near, near_n): both directions of every pair exactly one edit apart."""
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A small table that becomes a large one: spread it, whatever its own size.
    signed = counted.repartition(parts, "word").mapInArrow(_signed, "word string, n long, differs boolean, key long")
    a, b = signed.alias("a"), signed.alias("b")
    lengths = F.char_length("a.word") != F.char_length("b.word")
    pairs = (
        a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.differs") == F.col("b.differs"))
               & (F.col("a.word") < F.col("b.word")) & (F.col("a.differs") == lengths)
               & (F.levenshtein("a.word", "b.word", 1) == 1))
        .select(F.col("a.word").alias("x"), F.col("a.n").alias("xn"), F.col("b.word").alias("y"), F.col("b.n").alias("yn"))
        .distinct()
    )
    def side(word: str, n: str, near: str, near_n: str) -> Column:
        return F.struct(F.col(word).alias("word"), F.col(n).alias("n"), F.col(near).alias("near"), F.col(near_n).alias("near_n"))

    return pairs.select(F.explode(F.array(side("x", "xn", "y", "yn"), side("y", "yn", "x", "xn"))).alias("p")).select("p.*")


def _first_of_most(word: Column, n: Column) -> Column:
    return F.min(F.struct((-n).alias("n"), word.alias("word")))


def roots(forms: DataFrame, doublings: int) -> DataFrame:
    """(word, root) of every word with a form, followed 2 ** ``doublings`` steps."""
    reached = forms.select("word", F.col("form").alias("root"))
    for _ in range(doublings):
        reached = stored(reached)
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reached = reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return reached


def variants(
    docs: DataFrame, length: int = LENGTH, count: int = COUNT, times: int = TIMES, one_in: int = ONE_IN
) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word, the form it varies, and the last form."""
    if times < 2:
        raise ValueError("forms must be at least twice as frequent, or chains need not end")
    counted = stored(words(docs, length, count, one_in))
    near = near_words(counted).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), _first_of_most(F.col("near"), F.col("near_n")).alias("most")
    )
    found = counted.join(near, "word", "left")
    stands = -F.col("most.n") >= F.col("n") * times
    named = stored(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(stands, F.col("most.word")).alias("form"),
        F.when(stands, -F.col("most.n")).alias("form_n"),
    ))
    # Each step is to a word at least ``times`` as frequent, so the greatest count bounds the steps.
    most, steps = named.agg(F.max("n")).first()[0] or 0, 0
    while most >= count * times ** (steps + 1):
        steps += 1
    chased = roots(named.where("form is not null"), max(0, steps - 1).bit_length())
    return named.join(chased, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
