"""Secret scan with a random forest that removes false positives.

Candidates are the runs of key characters in words with a long one, and values assigned to
a name such as `token`, with their symbols. A forest scores each by its length, character transitions, dictionary
coverage, the document's path and the neighbouring words. Everything is built-in
expressions and the JVM's forest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import SPACES, fold, staged

SAMPLE_ROWS = 20_000
TREES = 24
DEPTH = 6
SECRET = 0.5
HELD_OUT_MODULUS = 5

# fixed values: patterns of candidates and of their surroundings
LONG_RUN = "(?=\\S*[0-9])\\S*[A-Za-z0-9+/_=-]{16,}\\S*"
KEYWORD = "(?i)(secret|token|passw(or)?d|passwd|pwd|api_?-?key|access_?-?key|private_?-?key|credential|auth|bearer)"
ASSIGNMENT = "(:|=|:=|=>|->|is)"
# fixed values: a name that a value is assigned to, inside one word or at the end of the word before
NAME = "(?:secret|token(?!iz|is)|passw(?:or)?d|passwd|pwd|api_?-?key|access_?-?key|private_?-?key|credential|auth(?!or(?!i[zs]))|bearer)"
NAMED = "(?i:[\\w./-]{0,60}?" + NAME + "[\\w./\\]-]{0,40}?)"
CLOSE, SIGN, OPEN = "(?:\\\\*[\"'`])?\\]?", "(?::=|=>|->|=|:(?!//))", "(?:\\\\*[\"'`])?"
ENDS_IN_SIGN = NAMED + CLOSE + SIGN + "$"
SCHEME = "(?i)(?:^|[^a-z])bearer$"
AUTHORIZATION = "(?i)authorization[\"'`]?[:=]$"
OPAQUE = "[0-9]|[A-Za-z0-9+/_=.~-]{16,}"
# fixed values: lines of a private key's block, the password in an address, keys known by their form
PRIVATE_KEY = "(-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----(?:\\s+(?:Proc-Type:\\s+\\S+|DEK-Info:\\s+\\S+))*|(?!^)\\G)((?:\\s|\\\\+[nr])+)([A-Za-z0-9+/=]{8,})"
KEY_LINE = "\ue000"  # stands before each line of a private key's block
LOGIN = "(?<=:)//[^\\s/:@\"'`]{0,80}:[^\\s/\"'`<>]{8,}?@(?=[\\w.\\[-]+(?:[^\\w.@-]|$))"
ACCESS_KEY = "(?:AKIA|ASIA)[A-Z0-9]{16}"
KNOWN = (
    "^/{0,2}(?:(?:AKIA|ASIA)[A-Z0-9]{16}$|gh[pousr]_\\w{36,}|github_pat_\\w{22,}|glpat-[\\w-]{20,}|xox[abeoprs]-[\\w-]{10,}|"
    "[sr]k_(?:live|test)_\\w{16,}|AIza[\\w-]{35}|SG\\.[\\w-]{16,}\\.[\\w-]{16,}|ya29\\.[\\w-]{20,}|npm_\\w{36}|sk-[\\w-]{20,}|"
    "hf_\\w{30,}|pypi-[\\w-]{50,}|eyJ[\\w-]{8,}\\.eyJ[\\w-]{8,}\\.)"
)
# fixed values: the parts of a word that can be values, the first that fits at each place
RUN = "[A-Za-z0-9+/_.~-]{8,}+(?:={1,2}(?![A-Za-z0-9]))?"
QUOTED = "(\\\\*[\"'`])(?:(?!\\1)\\S){8,}+(?:\\1|$)"
BARE = (
    "(?![\\w.]+[(\\[])(?![{(\\[$<])(?:(?![&,;|][\"'\\w.\\[\\]-]{1,80}[:=])[^\\s\"'`]){8,}+"
)
ASSIGNED = NAMED + CLOSE + SIGN + "(?:" + QUOTED + "|" + BARE + ")"
LOGIN_PIECE = "^//[^:]*:(.*)@$"
PIECE = KEY_LINE + "[A-Za-z0-9+/=]{8,}+|" + LOGIN + "|" + ASSIGNED + "|[\\w./-]{1,80}?" + CLOSE + SIGN + OPEN + "(?![\\w.]+[(\\[])" + RUN + "|" + RUN
HEAD = "^[\\w./\\]-]{1,140}?" + CLOSE + SIGN + OPEN + "(?=\\S{8})"
PLACEHOLDER = "(?i)(example|sample|dummy|changeme|placeholder|your|xxxx|0000|1234567|test|todo|redacted)"
TEST_PATH = "(?i)(test|example|sample|mock|fixture|doc|readme)"
CODE_PATH = "(?i)(\\.env|conf|settings|\\.ya?ml|\\.json|\\.properties|\\.py|\\.js|\\.sh)"
# fixed values: words whose letters count as dictionary coverage
DICTIONARY = (
    "access account address admin alpha application array author base beta bucket cache class client cloud code color "
    "column command comment common company config connect content context control country create customer data database "
    "date default delete design develop device document domain email empty engine error event example false field file "
    "filter first folder form format function general global group header hello home host html http image import index "
    "info input instance int internal item java key label language last length level library line link list local login "
    "main manager message method model module name network next node null number object option order output package page "
    "param password path policy port print private process product project property public query read record remote "
    "report request resource response result return role root rule sample schema script search secret section select "
    "server service session set simple size sort source spark start state static status store string style system table "
    "target task temp test text time title token total true type update upload user value version view web width window "
    "word work world write year zone"
).split()
FEATURES = [
    "length", "digits", "uppers", "symbols", "distinct", "entropy", "class_changes", "case_changes", "doubled",
    "consonants", "hex", "dictionary", "placeholder", "keyword_near", "assigned", "named", "quoted", "prose_near", "test_path",
    "code_path",
]


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.greatest(F.lit(1), F.length(value))


def _value(piece: Column, key: Column) -> Column:
    """What is assigned in a piece: without its quotes, or without the marks that end a bare value."""
    rest = F.substring(piece, F.length(key) + 1, F.length(piece))
    closed = F.when(rest.rlike("[({\\[]"), rest).otherwise(F.regexp_replace(rest, "[)\\]}]+[.,;]*$", ""))
    bare = F.regexp_replace(closed, "[\\\\.,;]+$", "")
    return (
        F.when(piece.startswith(KEY_LINE), F.substring(piece, 2, F.length(piece)))
        .when(piece.rlike(LOGIN_PIECE), F.regexp_extract(piece, LOGIN_PIECE, 1))
        .when(key.rlike("[\"'`]$"), F.regexp_replace(rest, "\\\\*[\"'`]$", ""))
        .when(key.rlike("(?i)" + NAME), bare)
        .otherwise(rest)
    )


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, path, position, word, key, value, before2, before and after of each candidate.

    A word has a candidate for each run of key characters; a value assigned to a secret's
    name is whole, with its symbols, up to the closing quote, the next pair or the word's
    end. `key` is the name it is assigned to and the sign, empty without one, `KEY_LINE`
    for the lines of a private key. Null and empty texts have none. The path is the `source` column where there is one.
    """
    path = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    words = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), path.alias("path"), F.col("text").cast("string").alias("_text")
    ).filter(
        F.col("_text").rlike(LONG_RUN) | F.col("_text").rlike(KEYWORD) | F.col("_text").rlike(LOGIN) | F.col("_text").rlike(ACCESS_KEY)
    )
    block = F.regexp_replace("_text", PRIVATE_KEY, "$1$2" + KEY_LINE + "$3")
    words = words.withColumn("_text", F.when(F.col("_text").contains("PRIVATE KEY-----"), block).otherwise(F.col("_text")))
    words = words.withColumn("_words", F.split("_text", SPACES)).drop("_text")
    at = lambda i: F.coalesce(F.get("_words", i), F.lit(""))
    apart = lambda i: at(i - 1).rlike("^" + ASSIGNMENT + "$") & at(i - 2).rlike(KEYWORD)
    signed = lambda i: F.right(at(i - 1), F.lit(1)).isin(":", "=", ">") & F.right(at(i - 1), F.lit(140)).rlike(ENDS_IN_SIGN)
    scheme = lambda i: (
        F.right(at(i - 1), F.lit(20)).rlike(SCHEME) | at(i - 1).rlike("^[A-Za-z-]+$") & at(i - 2).rlike(AUTHORIZATION)
    ) & at(i).rlike(OPAQUE)
    assigned = lambda i: (F.length(at(i)) >= 8) & (apart(i) | signed(i) | scheme(i))
    inside = lambda i: at(i).rlike(KEYWORD + "\\\\*[\"']?[:=]\\S{8,}")
    named = lambda i: F.when(~assigned(i), "").when(~apart(i) | at(i - 2).rlike("(?i)" + NAME), "secret=").otherwise("name=")
    found = F.filter(
        F.sequence(F.lit(0), F.size("_words") - 1),
        lambda i: at(i).rlike("^" + LONG_RUN + "$") | assigned(i) | inside(i) | at(i).rlike(LOGIN) | at(i).rlike(ACCESS_KEY) | at(i).contains(KEY_LINE),
    )
    rows = F.transform(
        found,
        lambda i: F.struct(
            i.alias("position"), at(i).alias("word"), at(i - 2).alias("before2"), at(i - 1).alias("before"), at(i + 1).alias("after"),
            named(i).alias("named"),
        ),
    )
    pieces = F.regexp_extract_all(F.concat("named", "word"), F.lit(PIECE), F.lit(0))
    return (
        words.select("doc_id", "path", F.explode(rows).alias("c"))
        .select("doc_id", "path", "c.*")
        .withColumn("piece", F.explode(pieces))
        .withColumn("key", F.when(F.col("piece").startswith(KEY_LINE), KEY_LINE).otherwise(F.regexp_extract("piece", HEAD, 0)))
        .withColumn("value", _value(F.col("piece"), F.col("key")))
        .filter(F.length("value") >= 8)
        .drop("named", "piece")
    )


def with_features(found: DataFrame) -> DataFrame:
    """The candidates with the forest's features as columns."""
    value = F.col("value")
    n = F.greatest(F.lit(1), F.length(value))
    letters = F.array_distinct(F.split(value, ""))
    share = lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / n
    entropy = F.aggregate(
        F.filter(letters, lambda c: c != ""), F.lit(0.0), lambda sum_, c: sum_ - share(c) * F.log2(share(c))
    )
    plain = F.regexp_replace(F.lower(value), "(" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + ")", "")
    near = F.concat_ws(" ", "before2", "before", "key", "value")
    columns = {
        "length": n.cast("double"),
        "digits": _share(value, "[0-9]"),
        "uppers": _share(value, "[A-Z]"),
        "symbols": _share(value, "[^A-Za-z0-9]"),
        "distinct": F.size(letters) / n,
        "entropy": entropy,
        "class_changes": _share(value, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"),
        "case_changes": _share(value, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "doubled": _share(value, "(.)(?=\\1)"),
        "consonants": _share(value, "(?i)[bcdfghjklmnpqrstvwxz](?=[bcdfghjklmnpqrstvwxz]{2})"),
        "hex": value.rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("double"),
        "dictionary": 1 - F.length(plain) / n,
        "placeholder": value.rlike(PLACEHOLDER).cast("double"),
        "keyword_near": near.rlike(KEYWORD).cast("double"),
        "assigned": (F.col("before").rlike("^" + ASSIGNMENT + "$|[:=]$|=>$") | (F.col("key") != "")).cast("double"),
        "named": (
            F.col("key").rlike("(?i)" + NAME) | (F.col("key") == KEY_LINE) | F.col("key").startswith("//") | value.rlike(KNOWN)
        ).cast("double"),
        "quoted": F.col("word").rlike("[\"'`]").cast("double"),
        "prose_near": F.concat_ws(" ", "before", "after").rlike("^[\\p{L}]+[.,;]? [\\p{L}]+").cast("double"),
        "test_path": F.col("path").rlike(TEST_PATH).cast("double"),
        "code_path": F.col("path").rlike(CODE_PATH).cast("double"),
    }
    return found.withColumns({k: v.cast("double") for k, v in columns.items()})


def weak_labels(found: DataFrame) -> DataFrame:
    """Stand-in for a table of labelled findings where there is none.

    A value assigned to a secret's name, one of a known form or an address's password is
    labelled 1 unless it is a placeholder or made of dictionary words, a line of a private
    key always, and any other candidate 0. Only rows whose fold (crc32 of the id modulo
    5) is not 0 are labelled.
    """
    secret = (F.col("named") > 0) & (F.col("placeholder") == 0) & (F.col("dictionary") < 0.5)
    return found.filter(F.coalesce(fold(F.col("doc_id"), HELD_OUT_MODULUS), F.lit(1)) != 0).withColumn(
        "label", (secret | (F.col("key") == KEY_LINE)).cast("double")
    )


def _sample(labelled: DataFrame, sample_rows: int) -> DataFrame:
    """At most `sample_rows` distinct rows in hash order, shared evenly by the labels.

    What a rare label leaves of its share goes to the other. Rows whose hash is far above
    the bound for their label are left out before copies are combined, so the shuffle is
    as small as the sample.
    """
    rows = labelled.withColumn("_hash", F.xxhash64(*FEATURES))
    about = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.approx_count_distinct("_hash", 0.02).alias("n")).collect()}
    share = sample_rows // max(1, len(about))

    def bounds(sizes: dict) -> dict:
        few = sum(min(n, share) for n in sizes.values())
        return {label: share if n <= share else sample_rows - few + share for label, n in sizes.items()}

    near = F.lit(False)
    for label, bound in bounds(about).items():
        part = min(1.0, (1.3 * bound + 200) / max(1, about[label]))
        low = F.col("_hash") <= int(-(2**63) + part * (2**64 - 1)) if part < 1 else F.lit(True)
        near = near | (F.col("label") == label) & low
    kept = staged(rows.filter(near).distinct(), "secret-sample")
    sizes = bounds({r["label"]: r["count"] for r in kept.groupBy("label").count().collect()})
    parts = [kept.filter(F.col("label") == label).orderBy("_hash", *FEATURES).limit(sizes[label]) for label in sorted(sizes)]
    return reduce(DataFrame.unionByName, parts, kept.limit(0)).drop("_hash")


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, position, value_sha256, value_length, probability and is_secret per candidate.

    The forest is fitted on at most `sample_rows` labelled findings (columns of
    `with_features` and `label`); without such a table `weak_labels` of the candidates are
    used. Where all labels of the table are equal, every candidate gets that label.
    Documents without candidates have no rows; repeated rows repeat their findings.
    """
    found = with_features(candidates(docs))
    weak = weak_labels(found) if labelled is None else labelled.filter(F.col("label").isNotNull())
    sample = _sample(weak.select(*FEATURES, F.col("label").cast("double").alias("label")), sample_rows)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="_features", handleInvalid="keep")
    low, high = sample.agg(F.min("label"), F.max("label")).first()
    if low == high:
        scored = found.withColumn("probability", F.lit(low or 0.0))
    else:
        forest = RandomForestClassifier(
            featuresCol="_features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=5, probabilityCol="_probability"
        ).fit(assembler.transform(sample))
        scored = forest.transform(assembler.transform(found)).withColumn(
            "probability", F.round(vector_to_array("_probability")[1], 6)
        )
    return scored.select(
        "doc_id",
        F.col("position").cast("bigint").alias("position"),
        F.sha2("value", 256).alias("value_sha256"),
        F.length("value").cast("bigint").alias("value_length"),
        "probability",
        (F.col("probability") >= SECRET).alias("is_secret"),
    )
