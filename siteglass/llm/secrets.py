"""Secret scans with a random forest that removes false positives, in DataFrame operations only.

A pattern proposes candidates: long unbroken runs of the characters that keys are made of,
values given to a credential word, and private key blocks. Each becomes a row of features (length, transitions between
kinds of characters, share covered by dictionary words, path marks, neighbouring words). A
random forest learns from labelled findings which of them are secrets; what it
confirms is masked in the text.
"""

from __future__ import annotations

from string import Formatter

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteglass.llm.common import row_key, saved

#: Words that name a credential, by length: what is looked for before a value has to have one.
_NAMES = (
    "pwd", "auth", "token", "secret|passwd|apikey|bearer", "api[_-]key", "password", "accesskey|secretkey",
    "access[_-]key|secret[_-]key|passphrase|credential",
)
# Between name and value: a closing quote, a blank, the sign, a blank, an opening quote; each may lack but the sign.
_SIGNS = [a + b + sign + c + d for a in ("", "[\"']") for b in ("", r"\s") for sign in ("[:=]", "(?:=>|:=)") for c in ("", r"\s") for d in ("", "[\"'`]")]
_GIVEN = "|".join([*(f"(?<=(?i:{n}){s})" for s in _SIGNS for n in _NAMES), r"(?<=(?i:bearer)\s)"])
# Tried first, as it is cheap and seldom holds: a sign or "bearer" stands right before.
_NEAR = r"(?<=[:=>])|(?<=[:=>][\s\"'`])|(?<=[:=>]\s[\"'`])|(?<=[rR]\s)"
#: What is proposed: private key blocks (up to the next line that begins or ends one), unbroken values of 8 or more characters given to a credential
#: word (a quoted one ends with its quote), and runs of 16 or more key characters (padding included).
CANDIDATE = (
    r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
    rf"|(?:{_NEAR})(?:{_GIVEN})(?:(?<=\")[^\s\"]{{8,}}|(?<=')[^\s']{{8,}}|(?<![\"'])[^\s\"'`]{{7,}}[^\s\"'`.,;)])"
    r"|(?<![A-Za-z0-9_+/.@-])(?=[_+/.@-]*[A-Za-z0-9])[A-Za-z0-9_+/.@-]{15,}[A-Za-z0-9_+/-]={0,2}"
)
#: Words that a dictionary lookup takes out of a candidate, longest first (three letters or more).
DICTIONARY = tuple(
    """example license password private public secret access number person people service
    project version window string system about after which their there would other these
    could first where mail with that this from have been were they what when will more
    test file user name home data json html http tion ment ción keit heit lich sich
    nicht eine dans pour avec elle eaux les des une que los del las por para the and ing
    for was are his her not you all can had has out our ent ver ich und der die das ein
    com org net www key""".split()
)
#: Words before a candidate that say it is a credential.
KEYWORDS = r"(?i)(token|secret|passw(or)?d|pwd|credential|api[_-]?key|access[_-]?key|auth|bearer)"
# Characters of a finding whose pairs are gathered at once.
_PIECE = 512
#: Words before a candidate that say it is a checksum or a name given by a machine.
DIGESTS = r"(?i)(commit|sha\d*|md5|checksum|digest|hash|etag|revision|request|uuid|trace)\W{1,3}$"
FEATURES = (
    "size", "digits", "uppers", "lowers", "symbols", "transitions", "distinct_pairs", "vowels",
    "covered", "dots", "slashes", "at_signs", "keyword_before", "assigned", "quoted", "hex_only",
    "words_before", "words_after", "digest_before", "called",
)
#: Labelled findings that a forest is fitted on at most.
TRAINING_ROWS = 20_000


def candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate in ``docs`` (doc_id, text): key_a, key_b, doc_id, place (from 0),
    finding, before, after (up to 60 characters of context). Rows that agree in id and text
    count once. NULL and empty texts have none."""
    parts = docs.where(F.col("text").rlike(CANDIDATE)).select(
        "doc_id", *row_key(),
        F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"),
        F.split("text", CANDIDATE, -1).alias("between"),
    )
    context = F.transform(
        "found",
        lambda x, i: F.struct(
            x.alias("finding"),
            # With the finding before it: a long name may be one itself.
            F.right(F.concat(F.coalesce(F.get("found", i - 1), F.lit("")), F.get("between", i)), F.lit(60)).alias("before"),
            F.left(F.get("between", i + 1), F.lit(60)).alias("after"),
        ),
    )
    rows = parts.select("doc_id", "key_a", "key_b", F.posexplode(context).alias("place", "c"))
    return rows.select("key_a", "key_b", "doc_id", "place", "c.finding", "c.before", "c.after")


def _count(signs: str) -> Column:
    """How many of the finding's characters are in the class ``signs``; no list of them is made."""
    return F.length(F.regexp_replace("finding", f"[^{signs}]", ""))


def _share(signs: str) -> Column:
    return _count(signs) / F.length("finding")


def _distinct_pairs() -> Column:
    """The number of different pairs of neighbouring characters, gathered over pieces of a bounded length."""

    def pairs(piece: Column) -> Column:
        signs = F.split(piece, "")
        n = F.length(piece) - 1
        return F.array_distinct(F.zip_with(F.slice(signs, F.lit(1), n), F.slice(signs, F.lit(2), n), lambda a, b: F.concat(a, b)))

    # Every piece with the first character of the next one.
    pieces = F.regexp_extract_all("finding", F.lit(f"(?s)(?=(.{{1,{_PIECE + 1}}})).{{1,{_PIECE}}}"), F.lit(1))
    none = F.array().cast("array<string>")
    return F.size(F.aggregate(pieces, none, lambda seen, piece: F.when(F.length(piece) > 1, F.array_union(seen, pairs(piece))).otherwise(seen)))


def with_features(found: DataFrame) -> DataFrame:
    """``found`` with the numbers the forest looks at (see FEATURES). Time and room grow with a finding's length, not its square."""
    kinds = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(F.regexp_replace("finding", "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d"), "[^lud]", "s"
    )
    changes = F.length(F.regexp_replace(kinds, r"([luds])\1*+", "$1")) - 1
    words = "|".join(sorted(DICTIONARY, key=len, reverse=True))
    uncovered = F.length(F.regexp_replace(F.lower("finding"), words, ""))
    numbers = {
        "size": F.least(F.length("finding"), F.lit(512)),
        "digits": _share("0-9"), "uppers": _share("A-Z"), "lowers": _share("a-z"), "symbols": 1 - _share("A-Za-z0-9"),
        "transitions": changes / F.length("finding"),
        "distinct_pairs": _distinct_pairs() / F.length("finding"),
        "vowels": _share("aeiouAEIOU"),
        "covered": 1 - uncovered / F.length("finding"),
        "dots": _count("."), "slashes": _count("/"), "at_signs": _count("@"),
        "keyword_before": F.right("before", F.lit(30)).rlike(KEYWORDS).cast("int"),
        "assigned": F.col("before").rlike(r"[=:]\s*[\"']?$").cast("int"),
        "quoted": F.col("before").rlike("[\"']$").cast("int"),
        "hex_only": F.col("finding").rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("int"),
        "words_before": F.regexp_count("before", F.lit("[A-Za-z]{2,}")),
        "words_after": F.regexp_count("after", F.lit("[A-Za-z]{2,}")),
        "digest_before": F.right("before", F.lit(30)).rlike(DIGESTS).cast("int"),
        "called": F.col("finding").rlike(r"^[<$({\[]|[)>}\]]$").cast("int"),
    }
    return found.select("*", *[numbers[name].cast("double").alias(name) for name in FEATURES])


def secret_by_rule() -> Column:
    """Whether a finding has a format that issuers fix, or is a value given to a credential word."""
    issued = F.col("finding").rlike(r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abp]-[0-9A-Za-z-]{10,}|-----BEGIN )")
    named = F.right("before", F.lit(30)).rlike(KEYWORDS + r"\W{1,5}$")
    mixed = F.col("finding").rlike(r"^(?=.*[A-Za-z])(?=.*[0-9!#$%^&*?~+])[^\s<>(){}\[\]$/@][^\s<>(){}\[\]/]{7,}$")
    given = named & (F.col("finding").rlike("^[0-9a-f]{16,}$") | (mixed & F.col("before").rlike(r"([=:]>?\s?[\"'`]?|(?i)bearer\s)$")))
    return issued | given


def seed_labels(found: DataFrame) -> DataFrame:
    """Findings labelled by rule, to hold a forest against and for one without a model: ``label`` 1 for formats that issuers
    fix and for values given to a credential word that are hexadecimal or mix letters with digits
    or signs, 0 for runs of letters, names, addresses and placeholders. What fits neither stays
    out of training and is left to the forest."""
    plain = F.col("finding").rlike(r"^(?:[A-Z](?=[a-z]))?[a-z]++(?:[.][a-z]*+)?$|^[A-Z]++$|@|^[A-Za-z]++(?:[-/.][A-Za-z]++)++$|^[$<({%\[]")
    return found.withColumn("label", F.when(secret_by_rule(), 1.0).when(plain, 0.0)).where("label is not null")


# Findings whose label doesn't come from a rule: values made at random in the places where they are met. Braces
# name what is made (see _made); the first group are secrets, the second look like them and are none.
PLANTED = {
    1.0: (
        "key {issued} in use", "remote: {granted} was pushed", 'token = "{hex40}"', "api_key: {hex32}", "password={hex20}", "secret='{base64}'",
        "then came {mixed32} and more", "run with {mixed24}", "mysql -p{mixed20}", "id -{mixed32} end", 'password = "{signs}"', '{{"passwd": "{signs}"}}',
        "pwd: {mixed12}", "Authorization: Bearer {bearer}", "aws_secret_access_key={mixed40}", "credential={base64}", "auth := `{mixed16}`",
        "hook {chat} for the channel", "-----BEGIN RSA PRIVATE KEY-----\n{base64}\n-----END RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----\n{mixed12}\n{mixed16}==\n-----END PRIVATE KEY-----", "{issued}", "passphrase => {signs}", "SECRET_KEY = '{mixed48}'",
    ),
    0.0: (
        "see {word}{word}{word} for that", "open https://www.{word}.com/{word}/{word}-{word}.html now", "write to {word}.{word}@mail.{word}.org please",
        "in /usr/local/{word}/{word}_{word}.py there", "commit {hex40} was merged", "sha256:{hex64} of the file", "checksum {hex32} agrees", "request {uuid} failed",
        "class {Word}{Word}{Word}Factory here", "password = ${{{WORD}_{WORD}_PASSWORD}}", "token = get_{word}_{word}()", "password: {word}{word}", 'password = "example{word}{two}"', 'api_key: "your_{word}_key_{two}"', "secret = <your-{word}-here>",
        "ISBN 978-3-16-{digits}-0 sold", "built v{two}.{two}.{two}-beta.{two}-linux today", "with release-{two}.{two}.{two}-{word}", "{Word}{word}{word}{word} at first", "{Letters} it was", "then {letters} too", "So. {Letters}", "{word}.{two}@mail{two}.{word}.com wrote", "set {WORD}_{WORD}_{WORD}_COUNT to it",
        "auth: {word}.{word}.{word}.{word}", "etag {hex32} unchanged", "call {digits}{digits} at noon", "tokens: {word}-{word}-{word}", "a/{word}/{word}/{word}/{word} path",
    ),
}
#: Planted findings that are made.
PLANTED_ROWS = 6_000


def _made(seed: Column) -> dict[str, Column]:
    """Random text of each kind that a template may name, from a number."""
    digest = [F.sha2(F.concat(seed.cast("string"), F.lit(f"/{k}")), 512) for k in range(8)]
    base64 = [F.base64(F.unhex(d)) for d in digest]
    mixed = F.regexp_replace(F.concat(base64[0], base64[1]), "[^A-Za-z0-9]", "")
    words = F.array(*map(F.lit, sorted(w for w in DICTIONARY if len(w) > 3)))
    word = [F.element_at(words, (F.conv(F.substr(digest[7], F.lit(4 * k + 1), F.lit(4)), 16, 10).cast("int") % F.size(words) + 1).cast("int")) for k in range(8)]
    return {
        "issued": F.concat(F.lit("AKIA"), F.left(F.regexp_replace(F.upper(F.concat(base64[2], base64[3])), "[^A-Z2-7]", ""), F.lit(16))),
        "granted": F.concat(F.lit("ghp_"), F.left(mixed, F.lit(36))), "chat": F.concat(F.lit("xoxb-"), F.left(F.conv(F.left(digest[4], F.lit(10)), 16, 10), F.lit(10)), F.lit("-"), F.left(mixed, F.lit(20))),
        **{f"hex{n}": F.left(digest[5], F.lit(n)) for n in (20, 32, 40, 64)}, **{f"mixed{n}": F.left(mixed, F.lit(n)) for n in (12, 16, 20, 24, 32, 40, 48)},
        "base64": F.left(base64[6], F.lit(44)), "signs": F.concat(F.left(mixed, F.lit(5)), F.translate(F.left(digest[2], F.lit(3)), "0123456789abcdef", "!#%&*?+~^!#%&*?+"), F.right(mixed, F.lit(4))),
        "bearer": F.concat(F.left(mixed, F.lit(9)), F.lit("-"), F.right(mixed, F.lit(8)), F.lit("."), F.substr(mixed, F.lit(20), F.lit(9))),
        "uuid": F.regexp_replace(F.left(digest[3], F.lit(32)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
        "digits": F.lpad(F.left(F.conv(F.left(digest[1], F.lit(12)), 16, 10), F.lit(8)), 8, "7"), "two": F.right(F.conv(F.left(digest[1], F.lit(12)), 16, 10), F.lit(2)),
        "letters": F.translate(F.left(digest[6], F.conv(F.left(digest[0], F.lit(1)), 16, 10).cast("int") + 16), "0123456789abcdef", "etaoinshrdlaeiou"),
        "words": F.array(*word),
    }


def planted_findings(spark: SparkSession, rows: int = PLANTED_ROWS) -> DataFrame:
    """Labelled findings as :func:`candidates` gives them, with ``label`` and ``template``: :data:`PLANTED`, filled at random.

    About as many of either label; the same rows every time.
    """
    made = {name: value.alias(name) for name, value in _made(F.col("id")).items()}
    numbers = spark.range(rows).select("id", *made.values())
    parts = []
    for label, templates in PLANTED.items():
        place = (F.floor(F.col("id") / 2) % len(templates) + 1).cast("int")
        # Among other words, so that the number of these says nothing.
        around = [F.array_join(F.slice(F.reverse("words") if k else F.col("words"), F.lit(1), (F.floor(F.col("id") / (7 + k)) % 8).cast("int")), " ") for k in range(2)]
        text = F.concat(around[0], F.lit(" "), F.element_at(F.array(*map(_filled, templates)), place), F.lit(" "), around[1])
        parts.append(numbers.where(F.col("id") % 2 == int(label)).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit(label).alias("label"), place.alias("template")))
    docs = saved(parts[0].union(parts[1]), "planted")
    found = saved(candidates(docs).join(docs.select("doc_id", "label", "template"), "doc_id"), "planted_findings")
    # The name before a value may be proposed as well; it is no secret.
    last = found.groupBy("doc_id").agg(F.max("place").alias("last"))
    return found.join(last, "doc_id").withColumn("label", F.when(F.col("place") == F.col("last"), F.col("label")).otherwise(0.0)).drop("last")


def _filled(template: str) -> Column:
    """The template with what its braces name; each word is another one."""
    pieces, word = [], 0
    for text, name, _, _ in Formatter().parse(template):
        pieces.append(F.lit(text))
        if name in ("word", "Word", "WORD"):
            one = F.get("words", F.lit(word))
            pieces.append({"word": one, "Word": F.initcap(one), "WORD": F.upper(one)}[name])
            word += 1
        elif name:
            pieces.append(F.initcap("letters") if name == "Letters" else F.col(name))
    return F.concat(*pieces)


def train(labelled: DataFrame, rows: int = TRAINING_ROWS, trees: int = 40, depth: int = 8, seed: int = 11) -> RandomForestClassificationModel | None:
    """A forest from findings with features and ``label`` (1 secret, 0 not).

    Fitted on at most about ``rows`` of them, chosen by a hash, equally many of each label
    as far as there are. None if one of the labels is missing.
    """
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if not (counts.get(1.0) and counts.get(0.0)):
        return None
    spread = F.pmod(F.xxhash64("finding", "key_a", "place"), F.lit(1 << 20)) / float(1 << 20)
    keep = F.when(F.col("label") == 1.0, spread < rows / 2 / counts[1.0]).otherwise(spread < rows / 2 / counts[0.0])
    chosen = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(labelled.where(keep)).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=32, cacheNodeIds=False).fit(saved_vectors(chosen))


def saved_vectors(chosen: DataFrame) -> DataFrame:
    return saved(chosen, "findings")


def judged(found: DataFrame, model: RandomForestClassificationModel | None, threshold: float = 0.5) -> DataFrame:
    """``found`` (with features) with probability and is_secret. Without a model, what :func:`seed_labels`
    calls a secret by its rules is one, and nothing else, whatever other candidates there are."""
    plain = found.drop(*FEATURES)
    if model is None:
        by_rule = F.coalesce(secret_by_rule(), F.lit(False))
        return plain.withColumns({"probability": by_rule.cast("double"), "is_secret": by_rule})
    scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found))
    return scored.select(*plain.columns, vector_to_array("probability")[1].alias("probability")).withColumn(
        "is_secret", F.col("probability") >= threshold
    )


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """All candidates of ``docs`` (doc_id, text), judged: key_a, key_b, doc_id, place, finding,
    before, after, probability, is_secret.

    ``labelled``: findings as :func:`candidates` gives them, with a ``label``; without any, the forest
    learns from :func:`planted_findings`, whatever ``docs`` holds.
    """
    found = saved(candidates(docs).distinct(), "candidates")
    featured = with_features(found)
    known = planted_findings(docs.sparkSession) if labelled is None else labelled
    return judged(featured, train(with_features(known)), threshold)


def redacted(docs: DataFrame, judgements: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs``, all columns and rows, with confirmed secrets in ``text`` replaced by ``mask``.

    Only documents that hold a confirmed secret meet the judgements in a join.
    """
    places = (
        judgements.where("is_secret").select("key_a", "key_b", "place").distinct()
        .groupBy("key_a", "key_b").agg(F.collect_set("place").alias("secret_places"))
    )
    columns = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "text", *row_key())
    proposed = F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False))
    joined = keyed.where(proposed).join(places, ["key_a", "key_b"], "left")
    found, between = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), F.split("text", CANDIDATE, -1)
    masked = F.transform(found, lambda x, i: F.when(F.array_contains("secret_places", i), F.lit(mask)).otherwise(x))
    rebuilt = F.array_join(F.flatten(F.zip_with(between, masked, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    changed = joined.select("row", F.when(F.col("secret_places").isNull(), F.col("text")).otherwise(rebuilt).alias("new_text"))
    untouched = keyed.where(~proposed).select("row", F.col("text").alias("new_text"))
    both = changed.union(untouched)
    return both.select(*[F.col("new_text").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns])
