"""Secrets in texts, with weak candidates linked across the parts of a credential. DataFrame functions only.

Some patterns stand for themselves (assigned secrets, access identifiers, long hex numbers).
Others are too weak alone: a login name, a short password or a bare mixed token, an address.
They are reported where complementary parts lie in one scope, that is in the same section of
the text (no blank line between them) and at most REACH characters apart:

- a login name with a secret,
- a weak secret with an identifier or an address,
- an address with a secret and an identifier.

Places come from the lengths of matches and of what lies between them, added up per document.
Texts are scanned where they lie; only these lengths are stored and shuffled, so no secret leaves the scan.
The scopes are an interval join: each candidate is dealt to the blocks of positions that its scope
touches, each part to the blocks that it covers, and both meet by (document, section,
block, need). It is a semi join: a candidate passes once per need, however many parts are near.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snaplytics.llm.common import stored, text_or_empty

REACH = 200  # characters between the parts of one credential
BLOCK = 256


def any_case(words: str) -> str:
    """A pattern for ``words`` with letters in either case, for ASCII letters only."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


GIVEN = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = f"({any_case('password|passwd|secret|token|api_?key')}){GIVEN}([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
LOGIN = f"({any_case('access_key_id|client_id|user_?name|user|login|account')}){GIVEN}[A-Za-z0-9@._+-]+"
TOKEN = "[A-Za-z0-9+/_-]{20,}"  # with small and capital letters and digits
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20"'<>\x7F]+"""
BREAK = r"\n[\x20\t\r]*\n"
MIN_ASSIGNED, MIN_WEAK = 12, 6  # characters of an assigned secret, and of a weak one

# Kinds in the order of output; a break only parts sections.
KINDS = ("assign", "access", "hex", "login", "key", "endpoint", "break")
ASSIGN_KIND, ACCESS_KIND, HEX_KIND, LOGIN_KIND, KEY_KIND, ENDPOINT_KIND, BREAK_KIND = range(7)
SECRET, IDENTIFIER, PARTNER = range(3)  # what a weak candidate may need; a partner is an identifier or an address
SERVES = {
    ASSIGN_KIND: (SECRET,),
    HEX_KIND: (SECRET,),
    KEY_KIND: (SECRET,),
    ACCESS_KIND: (IDENTIFIER, PARTNER),
    LOGIN_KIND: (IDENTIFIER, PARTNER),
    ENDPOINT_KIND: (PARTNER,),
}
NEEDS = {LOGIN_KIND: (SECRET,), KEY_KIND: (PARTNER,), ENDPOINT_KIND: (SECRET, IDENTIFIER)}


def _matches(text: Column, pattern: str, kind: Column) -> Column:
    """Per match of ``pattern``: what lies before it, its length, its kind. NULL without a match.

    ``kind`` is a column that may use ``match`` and ``value`` (the second group, if there is one).
    """
    groups = 2 if pattern == ASSIGN else 0
    pieces = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(groups)).alias("value"),
    )
    narrow = lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.length(p["match"]).alias("size"), kind(p).alias("kind"))
    matched = F.filter(pieces, lambda p: p["match"].isNotNull())
    return F.when(text.rlike(pattern), F.transform(matched, narrow))


def _assigned(piece: Column) -> Column:
    n = F.length(piece["value"])
    return F.when(n >= MIN_ASSIGNED, ASSIGN_KIND).when(n >= MIN_WEAK, KEY_KIND)


def _mixed(piece: Column) -> Column:
    match = piece["match"]
    return F.when(match.rlike("[a-z]") & match.rlike("[A-Z]") & match.rlike("[0-9]"), KEY_KIND)


def scanned(docs: DataFrame) -> DataFrame:
    """Per row its number, doc_id and the matches of every pattern as lengths; stored, and without any text."""
    text = text_or_empty()
    same = lambda kind: lambda p: F.lit(kind)
    patterns = (
        (ASSIGN, _assigned),
        (ACCESS, same(ACCESS_KIND)),
        (HEX, same(HEX_KIND)),
        (LOGIN, same(LOGIN_KIND)),
        (TOKEN, _mixed),
        (ENDPOINT, same(ENDPOINT_KIND)),
        (BREAK, same(BREAK_KIND)),
    )
    found = [_matches(text, pattern, kind).alias(f"found{i}") for i, (pattern, kind) in enumerate(patterns)]
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *found), "scanned")


def parts(scans: DataFrame) -> DataFrame:
    """Spans of all kinds: row, kind, start, end (code points, end exclusive)."""
    sources = [F.struct(F.lit(i).alias("source"), F.col(c).alias("found")) for i, c in enumerate(c for c in scans.columns if c.startswith("found"))]
    each = scans.select("row", F.inline(F.array(*sources))).filter("found is not null")
    each = each.select("row", "source", F.posexplode("found").alias("pos", "piece"))
    so_far = Window.partitionBy("row", "source").orderBy("pos")
    end = F.sum(F.col("piece.gap") + F.col("piece.size")).over(so_far).cast("long")
    spans = each.select("row", F.col("piece.kind").alias("kind"), F.col("piece.size").alias("size"), end.alias("end"))
    return spans.filter("kind is not null").select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def linked(spans: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak candidates of ``spans`` whose complementary parts lie in their scope."""
    is_base = F.col("kind") <= HEX_KIND
    in_order = Window.partitionBy("row").orderBy("start")
    onward = in_order.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    placed = spans.withColumns(
        {
            "section": F.sum((F.col("kind") == BREAK_KIND).cast("int")).over(in_order),
            "base_end": F.max(F.when(is_base, F.col("end"))).over(in_order),
            "base_start": F.min(F.when(is_base, F.col("start"))).over(onward),
        }
    ).filter(F.col("kind") != BREAK_KIND)
    # A weak secret that shares a character with a span of its own right is no further find.
    covered = (F.col("kind") == KEY_KIND) & F.coalesce((F.col("base_end") > F.col("start")) | (F.col("base_start") < F.col("end")), F.lit(False))
    placed = placed.filter(~covered)
    given = F.create_map(*[x for k, v in SERVES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    asked = F.create_map(*[x for k, v in NEEDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    block = lambda place: F.floor(place / BLOCK)
    candidates = (
        placed.filter(F.col("kind") > HEX_KIND)
        .select("row", "kind", "section", "start", "end", F.explode(asked[F.col("kind")]).alias("need"))
        .withColumn("block", F.explode(F.sequence(block(F.col("start") - reach), block(F.col("end") + reach))))
    )
    near = (
        placed.select("row", "section", F.col("start").alias("p_start"), F.col("end").alias("p_end"), F.explode(given[F.col("kind")]).alias("need"))
        .withColumn("block", F.explode(F.sequence(block(F.col("p_start")), block(F.col("p_end") - 1))))
    )
    c, n = candidates.alias("c"), near.alias("n")
    same = [F.col(f"c.{x}") == F.col(f"n.{x}") for x in ("row", "section", "block", "need")]
    within = (F.col("n.p_start") <= F.col("c.end") + reach) & (F.col("n.p_end") >= F.col("c.start") - reach)
    met = c.join(n, [*same, within], "left_semi").select("row", "kind", "start", "end", "need").distinct()
    met = met.groupBy("row", "kind", "start", "end").agg(F.count(F.lit(1)).alias("met"))
    return met.filter(F.col("met") == F.size(asked[F.col("kind")])).drop("met")


def _listed(condition: Column) -> Column:
    """Spans as kind:start:end, by start and kind, comma-joined."""
    item = F.struct("start", "kind", "end")
    ordered = F.sort_array(F.collect_list(F.when(condition, item)))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def find_credentials(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A null or empty text has no span: counts 0, the hash of nothing, and empty ``spans``. A null doc_id
    stays null; repeated rows are rows of their own; matches of one kind never overlap and are
    found from the left; spans that start at one place stand in the order of KINDS. Whole
    texts are scanned. An empty table gives no rows. Further columns are ignored.
    """
    scans = scanned(docs)
    spans = stored(parts(scans), "spans", "none")
    base = spans.filter(F.col("kind") <= HEX_KIND)
    rows = scans.select("row", "doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("kind", "int"), ("start", "long"), ("end", "long"))])
    found = base.unionByName(linked(spans)).withColumn("doc_id", F.lit(None).cast("long"))
    is_kind = lambda k: F.count(F.when(F.col("kind") == k, 1))
    return (
        rows.unionByName(found)
        .groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            is_kind(ASSIGN_KIND).alias("n_assign"),
            is_kind(ACCESS_KIND).alias("n_access"),
            is_kind(HEX_KIND).alias("n_hex"),
            F.sha2(_listed(F.col("kind") <= HEX_KIND).cast("binary"), 256).alias("base_sha256"),
            _listed(F.col("kind").isNotNull()).alias("spans"),
        )
        .drop("row")
    )
