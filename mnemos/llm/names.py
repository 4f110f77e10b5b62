"""Variant spellings of names typed by people.

Method: a name is taken apart (titles, initials, given name, legal form, trade),
blocked by phonetic codes of its tokens, whatever their order, compared with
Jaro-Winkler and a table of nicknames, and accepted pairs are clustered by
connected components. Every order of the tokens is a way to read a name, and
where the table knows no token, each may be the given name. More than ORDERED
tokens are read as typed and sorted only.

A name that leaves its given name or trade open ("W. Smith") would join
namesakes. Such names are linked in a second step, to the one cluster they fit;
where they fit several, to none.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from mnemos.llm.components import components
from mnemos.llm.grouped import bounds, in_blocks, over_groups, pairs_within
from mnemos.session import cut
from mnemos.sources.tables import table

# Common English given names with their short forms.
NICKNAMES = {
    "abigail": "abby gail", "albert": "al bert bertie", "alexander": "al alec alex sandy sasha xander", "alexandra": "alex lexi sandra sasha",
    "alfred": "al alf alfie fred", "amanda": "mandy", "andrew": "andy drew", "anne": "annie nan nancy", "anthony": "ant tony",
    "arthur": "art artie", "barbara": "babs barb barbie", "benjamin": "ben benji benny", "caroline": "carrie caro lina", "catherine": "cat cath cathy kate kathy kit kitty",
    "charles": "charlie chas chuck", "charlotte": "charlie lottie", "christina": "chris chrissy tina", "christopher": "chris kit kris topher", "daniel": "dan danny",
    "david": "dave davy", "deborah": "deb debbie", "dorothea": "dora dot dotty thea", "dorothy": "dolly dora dot dotty", "edward": "ed eddie eddy ned ted teddy",
    "eleanor": "ella ellie nell nora", "elizabeth": "bess beth betsy betty eliza libby lily lisa liz lizzie", "emily": "em emmy", "frances": "fanny fran frannie", "francis": "frank frankie",
    "frederick": "fred freddie freddy fritz rick", "gabriella": "bella gab gabby gabi ella", "george": "georgie", "gregory": "greg", "harold": "hal harry", "helen": "nell nellie",
    "henrietta": "etta hattie henny hetty etty", "henry": "hal hank harry", "isabella": "bella belle ella isa izzy", "jacob": "jake", "james": "jamie jim jimmy", "jennifer": "jen jenny",
    "john": "jack johnny", "jonathan": "jon jonny johnny nathan", "joseph": "joe joey", "josephine": "fifi jo joey josie", "judith": "judy", "katherine": "kate kathy kat katie kay kit kitty",
    "kenneth": "ken kenny", "lawrence": "larry laurie", "leonard": "len lenny leo", "margaret": "daisy greta madge maggie marge meg megan peg peggy rita", "martha": "marty patty",
    "matthew": "matt matty", "michael": "mick mickey mike mikey", "nathaniel": "nat nate nathan", "nicholas": "nick nicky", "oliver": "ol ollie noll", "pamela": "pam",
    "patricia": "pat patty tricia trish", "patrick": "pat paddy", "peter": "pete", "philip": "phil pip", "philippa": "phil pip pippa", "rebecca": "becca becky", "richard": "dick rich rick ricky",
    "robert": "bert bob bobby rob robbie", "samuel": "sam sammy", "sarah": "sadie sally", "stephen": "steve stevie", "susanna": "sue susan susie suzy sanna", "theodore": "ted teddy theo",
    "thomas": "tom tommy", "timothy": "tim timmy", "victoria": "tori tory vic vicky vicki", "vincent": "vin vince vinnie", "walter": "wally walt", "william": "bill billy will willie willy liam",
}
# Titles, legal forms and trades, each with its usual abbreviations.
TITLES = frozenset("mr mrs ms miss dr prof professor sir madam rev the".split())
LEGAL = {"incorporated": "inc", "corporation": "corp", "company": "co", "limited": "ltd lim", "gmbh": "", "plc": "", "llc": "", "llp": ""}
TRADES = {
    "associates": "assoc assocs", "brothers": "bros", "engineering": "eng engg engr", "enterprises": "ent", "group": "grp", "holdings": "hldgs hldg", "industries": "ind inds",
    "instruments": "instr instrs", "international": "intl int", "laboratories": "lab labs laboratory", "logistics": "log logs", "manufacturing": "mfg manuf", "partners": "ptnrs",
    "publishing": "pub publ", "services": "svcs svc serv", "shipping": "shpg", "solutions": "soln solns", "systems": "sys", "technologies": "tech technology", "trading": "trdg",
}


SURNAME = 0.88  # Jaro-Winkler from which on two surnames or firm names may be one
SLIP = 0.82  # the same, where there is only one slip
GIVEN = 0.86
EDITS = 3  # most slips in a core of nine letters or more; one less in a shorter one
ORDERED = 4  # most tokens of a core that are read in every order
BLOCK_ROWS = 3_000

_FORMAL: dict[str, frozenset[str]] = {}
for _f, _short in NICKNAMES.items():
    for _n in (_f, *_short.split()):
        _FORMAL[_n] = _FORMAL.get(_n, frozenset()) | {_f}
_ORG = {a: (k, "legal") for k, v in LEGAL.items() for a in (k, *v.split())} | {a: (k, "trade") for k, v in TRADES.items() for a in (k, *v.split())}


def jaro_winkler(a: str, b: str) -> float:
    """Between 0 and 1; two empty strings are equal."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                matched.append(c)
                break
    m = len(matched)
    if not m:
        return 0.0
    half = sum(x != y for x, y in zip(matched, (c for c, t in zip(b, taken) if t))) / 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours; ``most + 1`` if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(now[-1] + 1, row[j] + 1, row[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        before, row = row, now
    return min(row[-1], most + 1)


@lru_cache(100_000)
def _known(token: str, org: bool) -> tuple[str, ...]:
    """The entries of the table that a token spells, exactly or with a typo or two; the nearest, several if they are as near."""
    names = _ORG if org else _FORMAL
    if token in names:
        return (token,)
    if len(token) < (6 if org else 5):
        return ()
    near = {n: edits(token, n, 1 if len(n) < 7 else 2) for n in names if len(n) >= 5 and abs(len(n) - len(token)) <= 2}
    near = {n: d for n, d in near.items() if d <= (1 if len(n) < 7 else 2)}
    return tuple(sorted(n for n, d in near.items() if d == min(near.values())))


def plain(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def _split(token: str) -> tuple[str, str] | None:
    """A given name run together with a surname, as (given, surname)."""
    best = None
    for n in _FORMAL:
        for size in (len(n), len(n) - 1, len(n) + 1):
            if size >= 3 and len(token) - size >= 4:
                most = 0 if len(n) < 5 or size != len(n) and len(n) < 6 else 2 if len(n) >= 8 else 1
                d = edits(token[:size], n, most)
                if d <= most:
                    worth = (len(n) - 2.5 * d, -size)
                    if best is None or worth > best[0]:
                        best = (worth, n, token[size:])
    return best and best[1:]


def _orders(tokens: list[str]) -> list[str]:
    """The tokens run together, first as typed, then in other orders."""
    return ["".join(t) for t in (permutations(tokens) if len(tokens) <= ORDERED else (tokens, sorted(tokens)))]


class Name:
    """What a typed name says. ``kind`` "p" (person) or "o"; ``core`` the surname or the
    firm's own name; ``given`` the formal given names it may stand for, or an
    unknown one as typed; ``initial`` where only that is known; ``trade``; ``ways``
    all (given, core) it may be read as, the likeliest first."""

    __slots__ = ("core", "given", "initial", "kind", "trade", "ways")

    def __init__(self, typed: str) -> None:
        tokens = [t for t in re.findall(r"[^\W_]+", plain(typed)) if t not in TITLES]
        self.given, self.initial, self.trade = frozenset(), "", frozenset()
        org = {t: _ORG[k[0]] for t in tokens if len(t) > 1 and (k := _known(t, True))}
        self.kind = "o" if org and (len(tokens) > 2 or len(tokens) == 2 and len(org) < 2 and not any(_known(t, False) for t in tokens)) else "p"
        if self.kind == "o":
            own = [t for t in tokens if t not in org]
            self.trade = frozenset(k for k, what in org.values() if what == "trade")
            if not own:
                own, self.trade = sorted(tokens), frozenset()
            self._read([(self.given, c) for c in _orders(own)])
            return
        long = [t for t in tokens if len(t) > 1]
        letters = [t for t in tokens if len(t) == 1]
        if len(long) == 1 and not letters and (both := _split(long[0])):
            long = list(both)
        known = [t for t in long if _known(t, False)]
        if len(long) >= 2:
            # the given name is the one the table knows best, else any, most likely the first
            firsts = [min(known, key=lambda t: (t not in _FORMAL, long.index(t)))] if known else list(dict.fromkeys(long))
            ways = []
            for first in firsts:
                k = _known(first, False)
                given = frozenset().union(*(_FORMAL[x] for x in k)) if k else frozenset({first})
                rest = list(long)
                rest.remove(first)
                ways += [(given, c) for c in _orders(rest)]
            self._read(ways)
        else:
            self.initial = letters[0] if long and letters else ""
            self._read([(self.given, "".join(long) or "".join(letters))])

    def _read(self, ways: list[tuple[frozenset[str], str]]) -> None:
        self.ways = tuple(dict.fromkeys(ways))
        self.given, self.core = self.ways[0]

    def open(self) -> bool:
        """Whether it fits namesakes of different given names or trades."""
        return not self.trade if self.kind == "o" else not self.given

    def fits(self, other: Name, a: frozenset[str], b: frozenset[str]) -> bool:
        """Whether the kinds, trades or initials and the given names ``a`` and ``b`` read in them agree."""
        if self.kind != other.kind:
            return False
        if self.kind == "o":
            return not self.trade or not other.trade or self.trade == other.trade
        if a and b:
            return bool(a & b) or any(jaro_winkler(x, y) >= GIVEN for x in a - _FORMAL.keys() for y in b) or any(jaro_winkler(x, y) >= GIVEN for x in b - _FORMAL.keys() for y in a)
        i, j = self.initial, other.initial
        if a or b:
            letter = j if a else i
            return not letter or any(n[0] == letter for g in (a or b) for n in (g, *NICKNAMES.get(g, "").split()))
        return not i or not j or i == j

    def same(self, other: Name) -> bool:
        """Whether both may name one person or organisation."""
        # a slip may change the sorted order, so one name is read as typed, the other in every way
        both = [(self.ways[0], w) for w in other.ways] + [(w, other.ways[0]) for w in self.ways[1:]]
        return any(self.fits(other, a, b) and _alike(x, y) for (a, x), (b, y) in both)


def _alike(x: str, y: str) -> bool:
    """Whether two cores may be one."""
    if x == y:
        return True
    if min(len(x), len(y)) < 4:
        return False
    most = EDITS if min(len(x), len(y)) >= 9 else EDITS - 1
    # one slip near the front lowers Jaro-Winkler most
    return (j := jaro_winkler(x, y)) >= SLIP and edits(x, y, most if j >= SURNAME else 1) <= (most if j >= SURNAME else 1)


@lru_cache(50_000)
def _named(typed: str) -> Name:
    """A form lies in several blocks, so a worker that meets it again knows it already."""
    return Name(typed)


# Consonants that sound alike.
_SOUND = {c: str(i) for i, group in enumerate(("bfpv", "cgjkqsxz", "dt", "l", "mn", "r"), 1) for c in group}


def codes(name: Name) -> list[str]:
    """Phonetic codes: the consonants from the front, from the back, and the vowels
    of the core, and two consonants from either end beside each given name or trade,
    in every way to read the name. One slip leaves at least two of them as they were,
    two slips mostly one."""
    out: dict[str, None] = {}
    for given, core in name.ways:
        sounds = "".join(_SOUND.get(c, "") for c in core)
        vowels = "".join(c for c in core if c in "aeiouy")
        alone = ["f" + (core[:1] if core[:1] in "aeiouy" else "") + sounds[:4], "r" + sounds[::-1][:5], "v" + vowels]
        beside = [e for t in sorted(given | name.trade) for e in (f"{t} f{sounds[:2]}", f"{t} r{sounds[-2:]}")]
        out |= dict.fromkeys(alone + beside)
    return list(out)


def _parsed(forms: DataFrame) -> DataFrame:
    """(key, id, value, g) for every block a form lies in."""
    g_kind = forms.schema["g"].dataType
    schema = T.StructType([T.StructField("code", T.StringType()), T.StructField("id", T.LongType()), T.StructField("value", T.StringType()), T.StructField("g", g_kind)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, at = [], []
            for k, v in enumerate(b.column(1).to_pylist()):
                n = _named(v)
                for c in codes(n):
                    out.append(n.kind + c)
                    at.append(k)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), b.column(0).take(take), b.column(1).take(take), pa.array(b.column(2)).take(take)], ["code", "id", "value", "g"])

    return forms.select("id", "value", "g").mapInArrow(run, schema).select(F.xxhash64("g", "code").alias("key"), "id", "value", "g")


_LINK = T.StructType([T.StructField(n, k()) for n, k in (("a", T.LongType), ("b", T.LongType), ("a_open", T.BooleanType), ("b_open", T.BooleanType))])


def _compare(rows: DataFrame, many: int) -> DataFrame:
    """(a, b, a_open, b_open): accepted pairs of forms; a pair found in several blocks is repeated."""

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, part = t.column("id").to_numpy(), t.column("part").fill_null(-1).to_numpy()
        group = np.unique(t.column("g").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        names = [_named(v) for v in t.column("value").to_pylist()]
        full = np.uint64(2**64 - 1)

        def mask(n: Name) -> np.uint64:
            if n.kind == "o":
                return full if not n.trade else np.uint64(sum({1 << (hash(x) & 63) for x in n.trade}))
            sure = n.given and all(x in _FORMAL for x in n.given)
            return np.uint64(sum({1 << (hash(x) & 63) for x in n.given})) if sure else full

        masks = np.array([mask(n) for n in names], dtype=np.uint64)
        # an edit changes two of the letters a core has at most
        ways = [list(dict.fromkeys(sum({1 << (ord(c) & 31) for c in core}) for _, core in n.ways)) for n in names]
        widest = max(map(len, ways), default=1)
        letters = np.array([w + w[:1] * (widest - len(w)) for w in ways], dtype=np.uint64).reshape(-1, widest)

        def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            ok = np.bitwise_count(letters[a, 0] ^ letters[b, 0]) <= 2 * EDITS
            for w in range(1, widest):
                ok |= np.bitwise_count(letters[a, 0] ^ letters[b, w]) <= 2 * EDITS
                ok |= np.bitwise_count(letters[a, w] ^ letters[b, 0]) <= 2 * EDITS
            return ok

        found = [[], [], [], []]
        for a, b in pairs_within(bounds(t.column("key").to_numpy())):
            ok = near(a, b) & ((masks[a] & masks[b]) > 0) & (group[a] == group[b]) & (ids[a] != ids[b]) & ((part[a] < 0) | (part[a] != part[b]))
            for i, j in zip(a[ok].tolist(), b[ok].tolist()):
                if names[i].same(names[j]):
                    for x, v in zip(found, (ids[i], ids[j], names[i].open(), names[j].open())):
                        x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, to_arrow_type(f.dataType)) for x, f in zip(found, _LINK)], _LINK.names)

    return over_groups(rows, "key", run, _LINK, 5_000, many)


def link_names(entries: DataFrame, entry_id: str, name: str, within: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(``entry_id``, entity): one row per entry with a name; entries of one
    ``within`` that name the same person or organisation have the same number.

    Defined cases: entries with a null id, group or name, and names without a
    letter or digit, are left out; repeated rows count once, equal spellings are one
    form; an id under several names takes the smallest entity; a form without
    variants is an entity of its own; empty in, empty out; other columns are
    ignored. Blocks above ``block_rows`` forms are compared in pairs of blocks.
    """
    group = F.col(within) if within else F.lit(0)
    rows = entries.select(F.col(entry_id).alias("entry"), F.col(name).cast("string").alias("value"), group.alias("g")).where("entry is not null and g is not null")
    rows = rows.where(F.col("value").rlike(r"[\p{L}\p{N}]")).withColumn("id", F.xxhash64("g", "value")).distinct()
    # parsing is the work, not the bytes, so adaptive execution must not join these partitions
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    forms = rows.repartition(parts, "id").groupBy("id").agg(F.first("value").alias("value"), F.first("g").alias("g"))
    blocks = cut(_parsed(forms))  # parsed once, read for the blocks' sizes and for the blocks
    links = _compare(in_blocks(blocks, "key", "id", block_rows), blocks.count()).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.expr("if(a < b, a_open, b_open)").alias("a_open"), F.expr("if(a < b, b_open, a_open)").alias("b_open")
    )
    links = cut(links.distinct())  # four stages read it
    sure = links.where("not a_open and not b_open").select("a", "b")
    alone = forms.select(F.col("id").alias("a"), F.col("id").alias("b"))
    strong = components(sure.unionAll(alone), "a", "b")
    # an open form and the clusters of the forms it fits that are not open
    loose = links.where("a_open <> b_open").select(F.expr("if(a_open, a, b)").alias("id"), F.expr("if(a_open, b, a)").alias("to"))
    fits = loose.join(strong.select(F.col("id").alias("to"), "component"), "to").groupBy("id").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    placed = strong.join(fits, "id", "left").select("id", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("component")).alias("component"), F.col("low").isNotNull().alias("held"))
    placed = cut(placed)  # three stages read it
    # open forms that fit no cluster at all are clustered among themselves
    free = placed.where("not held").select("id")
    both = links.where("a_open and b_open").join(free.withColumnRenamed("id", "a"), "a", "left_semi").join(free.withColumnRenamed("id", "b"), "b", "left_semi")
    among = components(both.select("a", "b"), "a", "b").withColumnRenamed("component", "among")
    final = placed.join(among, "id", "left").select("id", F.coalesce("among", "component").alias("entity"))
    return rows.join(final, "id").groupBy("entry").agg(F.min("entity").alias("entity")).select(F.col("entry").alias(entry_id), "entity")


def _linked(spark: SparkSession, folder: str) -> DataFrame:
    entries = table(spark, folder, "catalogue_entries", "entry_id", "graph_id", "list_kind", "value").where("list_kind = 'entities'")
    return link_names(entries, "entry_id", "value", "graph_id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = _linked(spark, folder)
    a, b = found.withColumnRenamed("entry_id", "entry_id_a"), found.withColumnRenamed("entry_id", "entry_id_b")
    return a.join(b, "entity").where("entry_id_a < entry_id_b").select("entry_id_a", "entry_id_b")


def p6_entities(spark: SparkSession, folder: str) -> DataFrame:
    return _linked(spark, folder)


QUERIES = {"p6_found": p6_found, "p6_entities": p6_entities}
ORACLE: dict[str, str] = {}
