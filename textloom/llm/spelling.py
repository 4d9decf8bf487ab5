"""Spelling variants: words one edit apart, by merging the subtrees of a trie with one character skipped or replaced."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Letters of a run, the divisor of checksums that lose a letter, the least length and count of a word, how many times its own count a form must have.
LETTERS = r"[A-Za-zÀ-ÿ]+"
LOSSES, LEAST_LENGTH, LEAST_COUNT, TIMES = 199, 6, 5, 5
#: The trie is cut where a subtree holds at most so many words; above the cuts, nodes are merged by a join.
SUBTREE = 2048
#: Prefixes of a word that are counted at a time while cuts are sought.
DEPTHS = 8
#: Words of a crowded prefix that lie in one part while they are told so.
PART = 8192
#: Doublings that follow any chain of forms: each form has TIMES its word's count or more, so 32 steps would need a count beyond 2^63.
DOUBLINGS = 5


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts with their numbers of occurrences."""
    capitals = "".join(map(chr, range(65, 91)))
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(F.translate(F.col(text_col), capitals, capitals.lower()), F.lit(LETTERS), F.lit(0))).alias("run"))
    check = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    place = (F.col("check") % F.length("run")).cast("int")
    lost = F.concat(F.left("run", place), F.substr("run", place + 2))
    word = F.when(F.col("check") % LOSSES == 0, lost).otherwise(F.col("run"))
    # a run of fewer letters makes no word, whatever it loses
    found = runs.filter(F.length("run") >= LEAST_LENGTH).select("run", check.alias("check")).select(word.alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


@dataclass(slots=True)
class Node:
    """A node of a compact trie: the text of the edge above it, what ends here, and the subtrees by first letter."""

    label: str
    ends: list[int] = field(default_factory=list)
    below: dict[str, Node] = field(default_factory=dict)


def add(root: Node, text: str, number: int) -> list[int]:
    """Put a text below root (whose label is not part of it); returns the numbers that already end there."""
    node, at = root, 0
    while at < len(text):
        child = node.below.get(text[at])
        if child is None:
            node.below[text[at]] = Node(text[at:], [number])
            return []
        if text.startswith(child.label, at):
            node, at = child, at + len(child.label)
            continue
        shared = len(commonprefix([child.label, text[at : at + len(child.label)]]))
        upper = Node(child.label[:shared], [], {child.label[shared]: child})
        child.label, node.below[text[at]] = child.label[shared:], upper
        node, at = upper, at + shared
    before = list(node.ends)
    node.ends.append(number)
    return before


def find(node: Node, skip: int, text: str) -> list[int]:
    """What ends below node at a text that begins `skip` characters into its label."""
    at = len(node.label) - skip
    if text[:at] != node.label[skip:]:
        return []
    while at < len(text):
        node = node.below.get(text[at])
        if node is None or not text.startswith(node.label, at):
            return []
        at += len(node.label)
    return node.ends


def one_edit_pairs(sorted_words: list[str], depth: int) -> Iterator[tuple[int, int]]:
    """Pairs of numbers of the words, all with the same first `depth` characters, that one edit at or after depth leads to each other.

    The compact trie is walked along its heavy paths: at each node the subtrees but the heaviest are merged, letter replaced, into one
    errata trie and looked up in the heaviest one, and the edges' letters are skipped, so a word is moved only when its
    subtree doubles: log2(words) times at most. Where terminals coincide, two words are one edit apart. Each pair
    comes once: a letter of a run of equal ones is skipped where it is the last of its run.
    """
    root = Node(sorted_words[0][:depth])
    for k, w in enumerate(sorted_words):
        add(root, w[depth:], k)
    ranges = [(root, depth, 0, len(sorted_words))]  # node, length of the text that leads to it, its words
    while ranges:
        node, d, low, high = ranges.pop()
        at, children = low + len(node.ends), []
        for letter in sorted(node.below):
            child, begin = node.below[letter], at
            while at < high and sorted_words[at][d] == letter:
                at += 1
            children.append((child, begin, at))
            if at - begin > 1:
                ranges.append((child, d + len(child.label), begin, at))
        if not children:
            continue
        heavy, heavy_low, heavy_high = max(children, key=lambda c: c[2] - c[1])
        errata = Node("")
        for child, begin, end in children:
            if child is heavy:
                continue
            for k in range(begin, end):
                rest = sorted_words[k][d + 1 :]
                # a letter replaced, by another light one's or the heavy one's
                for other in (*add(errata, rest, k), *find(heavy, 1, rest)):
                    yield k, other
                # this letter skipped, or the heavy letter put before it
                if not rest.startswith(sorted_words[k][d]):
                    for other in node.ends if not rest else find(node.below[rest[0]], 0, rest) if rest[0] in node.below else []:
                        yield k, other
                for other in find(heavy, 1, sorted_words[k][d:]):
                    yield other, k
        # the heavy letter skipped and nothing after it; what goes on was met from the light side
        for other in find(heavy, 1, ""):
            for k in node.ends:
                yield other, k


def cut_depths(vocabulary: DataFrame) -> DataFrame:
    """(word, n, depth): depth is the length of a word's shortest prefix that at most SUBTREE words share, or the word's length."""
    open_, done, first = vocabulary.select("word", "n"), None, 0
    while True:
        depths = F.sequence(F.lit(first), F.least(F.length("word"), F.lit(first + DEPTHS - 1)))
        prefixes = open_.select("word", F.explode(depths).alias("depth")).select("word", "depth", F.left("word", F.col("depth")).alias("prefix"))
        crowded = materialize(prefixes.groupBy("depth", "prefix").agg(F.count("*").alias("words")).filter(F.col("words") > SUBTREE), "spelling-crowded")
        # words that share a crowded prefix are dealt over as many parts as the largest one of its length needs
        parts = {r["depth"]: 1 + r["words"] // PART for r in crowded.groupBy("depth").agg(F.max("words").alias("words")).collect()}
        most = F.get(F.lit([0] * first + [parts.get(d, 1) for d in range(first, first + DEPTHS)]), F.col("depth"))
        dealt = crowded.select("depth", "prefix", F.explode(F.sequence(F.lit(0), most - 1)).alias("part"))
        by_part = prefixes.withColumn("part", F.pmod(F.xxhash64("word"), most).cast("int"))
        deepest = by_part.join(dealt, ["depth", "prefix", "part"]).groupBy("word").agg(F.max("depth").alias("deepest"))
        cut = open_.join(deepest, "word", "left").withColumn("depth", F.least(F.coalesce(F.col("deepest") + 1, F.lit(first)), F.length("word")))
        cut = materialize(cut.select("word", "n", "depth"), "spelling-cuts")
        closed = (F.col("depth") < first + DEPTHS) | (F.col("depth") == F.length("word"))
        now = cut.filter(closed)
        done = now if done is None else done.union(now)
        open_, first = cut.filter(~closed).select("word", "n"), first + DEPTHS
        if open_.isEmpty():
            return done


def pairs_below(cut: DataFrame) -> DataFrame:
    """(word, n, near, near_n): pairs whose edit lies below their cut, one subtree a group."""

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = table.column("word").to_pylist()
        by = sorted(range(len(found)), key=found.__getitem__)
        both = list(one_edit_pairs([found[k] for k in by], key[0].as_py()))
        a, b = pa.array([by[i] for i, _ in both], pa.int64()), pa.array([by[j] for _, j in both], pa.int64())
        return pa.table({"word": table.column("word").take(a), "n": table.column("n").take(a), "near": table.column("word").take(b), "near_n": table.column("n").take(b)})

    groups = cut.withColumn("prefix", F.left("word", F.col("depth"))).groupBy("depth", "prefix")
    return groups.applyInArrow(merge, "word string, n long, near string, near_n long")


def pairs_above(cut: DataFrame) -> DataFrame:
    """(word, n, near, near_n): pairs whose edit lies above the cuts, where each letter passed is skipped or replaced.

    A node's subtrees that lie in several groups coincide where (depth, prefix, rest) are equal: at most one word for each letter, and the
    one without it, whatever the number of words below the node.
    """
    passed = cut.filter("depth > 0").select("word", "n", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("at"))
    rest = F.substr("word", F.col("at") + 2)
    skipped = passed.select("word", "n", "at", F.left("word", F.col("at")).alias("prefix"), rest.alias("rest"), F.substr("word", F.col("at") + 1, F.lit(1)).alias("letter"))
    whole = passed.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "at", F.left("word", F.col("at")).alias("prefix"), F.substr("word", F.col("at") + 1).alias("rest"))
    ending = cut.filter(F.length("word") == F.col("depth")).select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("depth").alias("at"), F.col("word").alias("prefix"), F.lit("").alias("rest"))
    key = ["at", "prefix", "rest"]
    other = skipped.select(F.col("word").alias("near"), F.col("n").alias("near_n"), *key, F.col("letter").alias("near_letter"))
    replaced = skipped.join(other, key).filter("letter < near_letter")
    shorter = skipped.filter(~F.startswith("rest", "letter")).join(whole.union(ending), key)
    columns = ["word", "n", "near", "near_n"]
    return replaced.select(columns).union(shorter.select(columns))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The words of a corpus with the more frequent spelling that each is one edit away from.

    Runs of Latin letters, A-Z lower-cased, are counted over all texts (aggregated before the shuffle); a run whose checksum with
    the document's id is divisible by LOSSES loses a letter, as a stated test of the search. Words have LEAST_LENGTH letters and
    LEAST_COUNT occurrences. The trie of all words is cut into subtrees of SUBTREE words: below the cuts, tasks
    merge light subtrees into heavy ones; above them, where a node's words lie in many tasks, the same merge is
    a join on what is left when its letter is skipped. No pair is lost, and no group grows with the corpus.

    A word's form is its near word of largest n (ties: the smallest in code-point order) if that is TIMES its own n or more. Its root
    is the last form of the chain. Null and empty texts have no words; null ids count as empty strings in the checksum; repeated
    rows count each. A long text is one row of a task, and a long word one edge of a trie. Empty tables give an empty table.
    Only id and text are read, so other columns cannot clash.

    Returns word, form, root, n, n_near, form_n.
    """
    vocabulary = materialize(words(docs, id_col, text_col), "spelling-words")
    cut = cut_depths(vocabulary)
    pairs = materialize(pairs_below(cut).union(pairs_above(cut)), "spelling-pairs")
    both = pairs.union(pairs.select("near", "near_n", "word", "n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    near = vocabulary.join(best, "word", "left")
    taken = -F.col("best.less") >= TIMES * F.col("n")
    formed = near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n"))
    formed = materialize(formed, "spelling-forms")
    chain = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        ahead = chain.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        chain = materialize(chain.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root")), "spelling-roots")
    return formed.join(chain, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
