"""Secret scan: candidate strings by pattern, false positives removed by a random forest; DataFrame operations only.

A candidate is a run of at least 12 key characters, or, of any length and characters, what follows a secret's name and an assignment, or
a run that starts with the prefix of a known kind of key. The forest's features are its length, transitions between kinds of characters, spread of characters, dictionary coverage, whether it lies in a path, and the words beside it. It is trained
from a table of labelled findings, by default one that SQL makes by rule.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|sk[-_]|pk_|xox[abprs]-|eyJ|ya29"
_MARK = r"(?::=|=>|==|[=:])\s{0,2}(?:(?i:bearer|basic)\s{1,2})?"
#: The lookaheads on letters that a name or prefix begins with only save time.
_ASSIGNED = rf"(?=[kKtTsSpPaAbBcC][eEoOaAwWuUrRpP])(?i:key|token|secret|passw|pwd|auth|bearer|credential|private|api)[A-Za-z0-9_-]{{0,12}}[\"'`]?\s{{0,2}}{_MARK}"
#: A quoted value up to its closing quote, any other up to white space, a quote, or closing punctuation.
_VALUE = r"(?!(?i:bearer|basic)\s)[^\s\"'`]*[^\s\"'`,;.)\]}>]"
#: A secret's name, an assignment and the value, read forwards: a lookbehind as long as a name would be tried at each character.
NAMED = f"{_ASSIGNED}(?:{'|'.join(f'{q}[^{q}{chr(92)}n]+(?={q})' for q in (chr(34), chr(39), '`'))}|[\"'`]?{_VALUE})"
#: Runs of key characters, and runs with a known prefix.
RUN = rf"(?<![A-Za-z0-9_+/-])(?:(?=[Agspxey])(?:{PREFIX}){_VALUE}|[A-Za-z0-9_+/-]{{12,}}+(?:={{1,2}}(?![A-Za-z0-9_+/\"'`=-]))?)"
#: Code points of text beside a candidate that are looked at.
BESIDE = 32
TREES, DEPTH, SEED = 24, 6, 13
#: Words whose share of a candidate's characters is its dictionary coverage.
WORDS = "about account admin agent alpha answer apple apply april august base batch beta block board build cache call card case chapter check city class client code commit config count country data date debug demo dev doc draft email error event example fail field figure file final first format from group guide host house image index info input issue item january java key kind label level light line link list local log main march master member memory model month name node note number object office order output page part path people phone place plan point post press print product public range read record release report room row run sample scale school section server service set size source stage start state story street string study system table task team test text time title token tool total type unit update user value version view volume water web week window word work world year".split()
FEATURES = ("length", "digits", "uppers", "lowers", "turns", "spread", "vowels", "covered", "hex", "uuid", "dated", "slashes", "dashes", "in_path", "named_secret", "named_other", "assigned", "prefixed", "symbols", "spaces", "told")


def _share(text: Column, pattern: str, n: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))) / n


def with_features(found: DataFrame) -> DataFrame:
    """Columns FEATURES (double) of rows with `candidate`, `before` and `after` (text beside it)."""
    c, n = F.col("candidate"), F.greatest(F.length("candidate"), F.lit(1)).cast("double")
    before, near = F.lower("before"), F.lower(F.concat_ws(" ", "before", "after"))
    words = "|".join(sorted(WORDS, key=len, reverse=True))
    columns = {
        "length": F.least(n, F.lit(200.0)),
        "digits": _share(c, "[0-9]", n),
        "uppers": _share(c, "[A-Z]", n),
        "lowers": _share(c, "[a-z]", n),
        "turns": _share(c, "(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]", n),
        "spread": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64.0)),
        "vowels": _share(c, "[aeiouAEIOU]", n),
        "covered": F.length(F.array_join(F.regexp_extract_all(F.lower(c), F.lit(words), F.lit(0)), "")) / n,
        "hex": c.rlike("^[0-9a-f]+$|^[0-9A-F]+$"),
        "uuid": c.rlike("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"),
        "dated": c.rlike("(19|20)[0-9]{2}[-_/]?[01][0-9][-_/]?[0-3][0-9]"),
        "slashes": _share(c, "/", n),
        "dashes": _share(c, "[-_]", n),
        "in_path": F.col("before").rlike(r"[./\\:]$") | F.col("after").rlike(r"^[./\\][A-Za-z]"),
        "named_secret": before.rlike(r"(key|token|secret|passw|pwd|auth|bearer|credential|private|api)[^.!?\n]{0,12}$"),
        "named_other": near.rlike(r"(commit|sha|hash|checksum|digest|md5|uuid|guid|\bid\b|version|revision|build|etag|order|phone|card|isbn|row)"),
        "assigned": F.col("before").rlike(r"[=:]\s{0,2}[\"'`]?$"),
        "prefixed": c.rlike(f"^({PREFIX})"),
        "symbols": _share(c, r"[^A-Za-z0-9_+/\s-]", n),
        "spaces": _share(c, r"\s", n),
        "told": F.col("before").rlike(r":\s{1,2}$"),
    }
    return found.withColumns({k: v.cast("double") for k, v in columns.items()}).fillna(0.0, list(columns))


def labelled_findings(spark: SparkSession, n: int = 2400) -> DataFrame:
    """(candidate, before, after, label): n findings made by rule, half of them secrets, in equal parts of each shape."""
    hexa = "sha2(concat('s', id), 256)"
    upper = f"upper(translate({hexa}, '0123456789abcdef', 'K3QZ7HWXM5ADJ2TR'))"
    mixed = f"concat(translate(substr({hexa}, 1, 22), '0123456789abcdef', 'kQ7zHw3XmA5dJt2R'), translate(substr({hexa}, 30, 22), '0123456789abcdef', 'Bv9nE1pLsY6gUc4f'))"
    name = "element_at(array('key', 'token', 'api_key', 'password', 'secret', 'auth'), 1 + cast(pmod(hash(id, 1), 6) as int))"
    mark = "element_at(array('=', ' = \"', ': ', ': \\'', '=\"'), 1 + cast(pmod(hash(id, 2), 5) as int))"
    word = lambda i: f"element_at(array('main', 'report', 'release', 'chapter', 'table', 'user', 'index', 'server', 'config', 'sample'), 1 + cast(pmod(hash(id, {i}), 10) as int))"
    number = lambda i, m: f"cast(pmod(hash(id, {i}), {m}) as string)"
    prose = f"translate(substr({hexa}, 1, 12 + cast(pmod(hash(id, 3), 8) as int)), '0123456789abcdef', 'ehtinoaersbldchu')"
    shapes = [  # candidate, before, after, label
        (f"concat('AKIA', substr({upper}, 1, 16))", "'here and there '", "' and more text'", 1),
        (f"substr({hexa}, 1, 40)", f"concat('some text ', {name}, {mark})", "'\" in the text'", 1),
        (f"substr({hexa}, 1, 18)", f"concat('and then ', {name}, {mark})", "' the next words'", 1),
        (f"concat('ghp_', substr({mixed}, 1, 36))", "'in the file '", "' was found'", 1),
        (f"substr({mixed}, 1, 40)", f"concat('set ', {name}, {mark})", "'\"'", 1),
        (f"concat('sk-', substr({mixed}, 3, 40))", "'text '", "' text'", 1),
        (f"concat(substr({mixed}, 1, 42), '==')", f"concat('use ', {name}, {mark})", "' now'", 1),
        (f"substr({mixed}, 4, 32)", "'curl -H \"Authorization: Bearer '", "'\" next'", 1),
        (f"concat(substr({hexa}, 1, 8), '-', substr({hexa}, 9, 4), '-', substr({hexa}, 13, 4), '-', substr({hexa}, 17, 4), '-', substr({hexa}, 21, 12))", "'the row with id '", "' is old'", 0),
        (f"substr({hexa}, 1, 40)", "'fixed in commit '", "' last week'", 0),
        (f"substr({hexa}, 1, 32)", "'md5 checksum '", "'  file.tar'", 0),
        (f"substr({hexa}, 1, 64)", "'sha256: '", "' of the file'", 0),
        (f"concat({word(3)}, '_', {word(4)}, '_', {number(5, 100)}, '_', {word(6)})", "'call '", "'(x)'", 0),
        (f"concat({word(3)}, '/', {word(4)}, '/v', {number(5, 9)}, '/', {word(6)})", "'see src/'", "'.txt for'", 0),
        (f"concat('20', lpad({number(3, 30)}, 2, '0'), '-0', {number(4, 9)}, '-1', {number(5, 9)}, '-', {word(6)})", "'in '", "' we saw'", 0),
        (f"concat('4', lpad({number(3, 100000000)}, 8, '7'), lpad({number(4, 10000000)}, 7, '1'))", "'paid with card '", "' in the town'", 0),
        (f"concat('555-', lpad({number(3, 1000)}, 3, '0'), '-', lpad({number(4, 10000)}, 4, '2'), '-', {number(5, 90)})", "'phone '", "' after 5'", 0),
        (f"concat({word(3)}, '-', {word(4)}, '-', {number(5, 50)}, '-', {word(7)})", "'https://site.example/'", "'/page.html'", 0),
        (f"concat('your-', {word(3)}, '-', {word(4)}, '-', {number(5, 10)})", f"concat({name}, {mark})", "' (example)'", 0),
        (f"repeat({number(3, 10)}, 16)", "'the number '", "' is printed'", 0),
        (f"concat('AKIA', translate(substr({upper}, 1, 16), '23457', 'BCEFG'))", "'here and there '", "' and more text'", 1),
        (f"translate(substr({mixed}, 1, 16), '0123456789', 'CDFGhjklPN')", f"concat('set ', {name}, {mark})", "'\" in the text'", 1),
        (f"concat(substr({mixed}, 1, 4), '!', substr({mixed}, 9, 3), '$')", f"concat('set ', {name}, {mark})", "' and then'", 1),
        (f"concat(substr({word(3)}, 1, 3), '!', substr({word(4)}, 1, 4), '$')", f"concat('set ', {name}, {mark})", "' and then'", 1),
        (f"concat({word(3)}, {word(4)}, {word(5)})", f"concat('set ', {name}, '=')", "' in the text'", 1),
        (f"concat({word(3)}, ' ', {word(4)}, ' ', {word(5)})", f"concat({name}, '=\"')", "'\" in the text'", 1),
        (f"concat('eyJ', substr({mixed}, 1, 20), '.', substr({mixed}, 5, 30))", "'text '", "' text'", 1),
        (f"concat({word(3)}, {word(4)})", "'some words of the '", "' and more text'", 0),
        (f"initcap({prose})", "'some words. '", "' and more text'", 0),
        (f"upper({prose})", "'SOME WORDS '", "' AND MORE'", 0),
        (prose, "'some words of the '", "' and more text'", 0),
        (f"concat({word(3)}, '/', {word(4)}, '/', {word(6)})", "'either '", "' or none'", 0),
        (f"concat({word(3)}, '-', {word(4)}, '_', {word(6)})", "'the '", "' of it'", 0),
        (word(3), f"concat('the ', {name}, ': ')", "' is what we saw'", 0),
        (f"repeat(element_at(array('-', '_', '+', '/'), 1 + cast(pmod(hash(id, 3), 4) as int)), 12 + cast(pmod(hash(id, 4), 60) as int))", "'text '", "' text'", 0),
    ]
    case = lambda i: "case pmod(id, {}) {} end".format(len(shapes), " ".join(f"when {k} then {s[i]}" for k, s in enumerate(shapes)))
    return spark.range(n).selectExpr(f"{case(0)} as candidate", f"{case(1)} as before", f"{case(2)} as after", f"cast({case(3)} as double) as label")


def train(findings: DataFrame) -> RandomForestClassificationModel:
    """A forest from labelled findings (candidate, before, after, label 0 or 1); their number is bounded by whoever labels them."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(findings.where("label is not null").fillna("", ["candidate", "before", "after"])))
    return RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(rows.select("label", "features"))


def _found(gaps: Column, hits: Column) -> Column:
    """(start, hit, before, after) of the matches of a pattern, from what lies between them and the matches. The text beside a match reaches
    over the match next to it."""
    n = F.size(hits)
    tail, head = (lambda x: F.right(x, F.lit(BESIDE))), (lambda x: F.left(x, F.lit(BESIDE)))
    before = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), F.coalesce(h, F.lit("")).alias("hit")))
    after = F.zip_with(F.slice(gaps, 2, n), F.slice(hits, 2, n), lambda g, h: head(F.concat(head(g), head(F.coalesce(h, F.lit(""))))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("tail"), F.array().cast("array<struct<start:bigint,hit:string,before:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["gap"])
        beside = tail(F.concat(acc["tail"], tail(x["gap"])))
        one = F.struct(at.alias("start"), x["hit"].alias("hit"), beside.alias("before"))
        return F.struct((at + F.length(x["hit"])).alias("at"), tail(F.concat(beside, tail(x["hit"]))).alias("tail"), F.array_append(acc["out"], one).alias("out"))

    placed = F.aggregate(F.slice(before, 1, n), start, step)["out"]
    return F.zip_with(placed, after, lambda x, y: F.struct(x["start"].alias("start"), x["hit"].alias("hit"), x["before"].alias("before"), y.alias("after")))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, start, end (code points, end exclusive), candidate, before, after of `docs` (doc_id, text): values of a secret's name, and runs
    that share no character with one of these."""
    # Columns of their own, so that each pattern is run twice a text and not for every use of its result.
    both = {"named": NAMED, "run": RUN}
    x = docs.select("doc_id", *(c for k, p in both.items() for c in (F.split("text", p, -1).alias(f"{k}_gaps"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"{k}_hits"))))
    x = x.select("doc_id", *(_found(F.col(f"{k}_gaps"), F.col(f"{k}_hits")).alias(k) for k in both)).withColumnRenamed("run", "runs")

    def value(m: Column) -> Column:
        own = F.regexp_extract(m["hit"], rf"(?s)^{_ASSIGNED}[\"'`]?(.+)\z", 1)
        name = F.left(m["hit"], F.length(m["hit"]) - F.length(own))
        return F.struct((m["start"] + F.length(name)).alias("start"), own.alias("hit"), F.right(F.concat(m["before"], F.right(name, F.lit(BESIDE))), F.lit(BESIDE)).alias("before"), m["after"].alias("after"))

    x = x.select("doc_id", F.transform("named", value).alias("named"), "runs")
    free = F.filter("runs", lambda r: ~F.exists("named", lambda v: (v["start"] < r["start"] + F.length(r["hit"])) & (r["start"] < v["start"] + F.length(v["hit"]))))
    each = x.select("doc_id", F.explode(F.concat("named", free)).alias("x")).where("x.hit <> ''")
    return each.select("doc_id", "x.start", (F.col("x.start") + F.length("x.hit")).alias("end"), F.col("x.hit").alias("candidate"), "x.before", "x.after")


def scan(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """One row per candidate of each row of `docs` (doc_id, text): doc_id, start, end, candidate, score, is_secret (score >= 0.5).

    Whole texts are scanned. Null or empty texts have no candidates; rows with null ids and repeated rows are scanned like any other; no
    rows give none."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    forest = train(labelled_findings(docs.sparkSession) if findings is None else findings)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(candidates(docs)))
    scored = forest.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "start", "end", "candidate", "score", (F.col("score") >= 0.5).alias("is_secret"))


def op9(docs: DataFrame) -> DataFrame:
    """The findings of `scan` in documents, with the candidate's sha256 in place of the candidate."""
    return scan(docs).select("doc_id", "start", "end", F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), "score", "is_secret")
