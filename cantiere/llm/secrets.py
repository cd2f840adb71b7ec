"""Secret scan: candidates by pattern, false positives removed by a random forest. DataFrame functions only.

Candidates are runs of at least 16 letters, digits and ``_+/-`` with a digit; runs of any kind
that begin with an issuer's prefix; every value of at least 6 characters, of any kind and length, that a name with a secret word of
its own and an assignment sign introduce; and passwords of URLs. Their
features are length, changes of character class, shares of digits, capitals, vowels and distinct characters, how much
of it dictionary words cover, path signs, and the words around it. The forest is trained by Spark ML on labelled
findings and rewritten as one SQL expression, so that a text is scanned, judged and redacted inside its row: there
is no shuffle, and ids play no part.

NULL and blank texts have no findings. Repeated rows and ids are scanned row by row. Other columns are ignored, and
kept as they are by ``redact``. Labelled texts that are NULL or hold no candidate teach nothing; labels of one kind only
give a forest that always answers with it; without labels every candidate is a secret.
"""

from __future__ import annotations

import re
import uuid

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cantiere.llm.common import landed

RUN = "[A-Za-z0-9_+/-]"
CANDIDATE = f"(?<!{RUN})(?=[A-Za-z_+/-]*+[0-9]){RUN}{{16,}}={{0,2}}"
WHITE = r"[\x20\x09-\x0D]+"
#: Words that name a secret, and words that name other runs of characters.
SECRET_WORDS = ("token tokens secret secrets password passwords passwd passwort passphrase passcode pass pwd key keys apikey apikeys secretkey accesskey "
                "auth authtoken authorization bearer credential credentials login").split()
OTHER_WORDS = "commit|sha1|sha256|md5|hash|digest|checksum|uuid|guid|version|order|number|invoice|build|revision|example|sample|placeholder|path|file"
#: Assigned values up to so many characters are looked for behind every name, also inside of other values; longer ones one behind the other.
VALUE_CHARS = 1000
ISSUERS = "AKIA|ASIA|ghp_|gho_|ghs_|xox[abp]-|sk-|sk_live|AIza|eyJ|glpat-"
ISSUED = f"(?<![A-Za-z0-9])(?:{ISSUERS}){RUN}{{12,}}={{0,2}}"
_WORDS, _CAPITAL = "|".join(SECRET_WORDS), "|".join(w.capitalize() for w in SECRET_WORDS)
#: A secret word that is a word of its own in a name: between other signs, or set off by capitals.
_FIRST = "".join(sorted({w[0] for w in SECRET_WORDS}))
NAMED = (f"(?=[{_FIRST}{_FIRST.upper()}])(?:(?<![A-Za-z])(?:(?i:{_WORDS})(?![A-Za-z])|(?:{_WORDS}|{_CAPITAL})(?=[A-Z]))|"
         f"(?=[{_FIRST.upper()}])(?<=[A-Za-z0-9])(?:{_CAPITAL})(?![a-z]))")
#: The name to its end, the sign and what may stand before the value; and the value, within quotes or up to white space.
_NAME = f"{NAMED}[A-Za-z0-9_.-]{{0,40}}"
_SIGN = r"[\x22\x27\]]{0,2}\s{0,4}(?:=>|:=|==?|:)\s{0,4}(?:(?i:bearer|basic)\s{1,4})?+[\x22\x27`]?"
_VALUE = (rf"(?:(?<=\x22)[^\x22\r\n]{{6,{VALUE_CHARS}}}(?=\x22)|(?<=\x27)[^\x27\r\n]{{6,{VALUE_CHARS}}}(?=\x27)|"
          rf"[^\s\x22\x27`]{{6,{VALUE_CHARS}}}(?![^\s\x22\x27`]))")
_LONG_VALUE = (rf"(?:(?<=\x22)[^\x22\r\n]{{{VALUE_CHARS + 1},}}+(?=\x22)|(?<=\x27)[^\x27\r\n]{{{VALUE_CHARS + 1},}}+(?=\x27)|"
               rf"[^\s\x22\x27`]{{{VALUE_CHARS + 1},}}+)")
#: Only the name is consumed, so that an assignment inside a value is found as well.
ASSIGNED = f"(?=({_NAME}{_SIGN}{_VALUE})){_NAME}"
ASSIGNED_LONG = f"{_NAME}{_SIGN}{_LONG_VALUE}"
#: What stands before an assigned value, once a match is cut out of its text; and signs that end a sentence, not a value.
_INTRODUCED = f"^[A-Za-z0-9_.-]+{_SIGN}"
_CLOSING = ",;.)]}>"
#: The password of a URL with the user before it.
URL = r"://[^\s/:@]{0,200}:[^\s/@]{3,}+(?=@)"
#: Words that identifiers and paths are made of.
DICTIONARY = ("about access account action address admin array base block body build button cache call change check class client code color "
              "column command config content context control count create current data date default delete detail device dir display doc "
              "document element email enable end entry error event example field file filter find first form format function get group "
              "handler header home host html http image index info init input insert item json key label language last layout level lib "
              "line link list load local lock log main manager map max message method min mode model module name new next node none "
              "number object open option order output package page param parent parse password path plugin point post print process "
              "profile project property query read record refresh remove render replace report request reset resource response result "
              "return role root row run sample save schema script search secret select send server service session set share simple "
              "site size sort source start state status step stop storage store string style submit system table tag target task temp "
              "template test text time title token tool top total track tree type update upload url user util value version view "
              "warning web widget window word work write your here").split()
TREES, DEPTH, THRESHOLD = 24, 6, 0.5
#: At most so many labelled findings are learnt, those with the smallest hash.
FIT_ROWS = 20_000
MASK = "[SECRET]"
_KIND = "array<struct<text:string,before:string,word:string,after:string>>"

#: Feature -> SQL over a finding ``f`` with fields text, before, word, after.
_LEN = "CAST(length(f.text) AS DOUBLE)"
_LETTERS = "length(regexp_replace(f.text, '[^A-Za-z]', ''))"
FEATURES = {
    "length": _LEN,
    "transitions": f"(length(regexp_replace(f.text, '[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+', '.')) - 1) / {_LEN}",
    "digit_share": f"length(regexp_replace(f.text, '[^0-9]', '')) / {_LEN}",
    "upper_share": f"length(regexp_replace(f.text, '[^A-Z]', '')) / {_LEN}",
    "vowel_share": f"length(regexp_replace(f.text, '[^aeiouAEIOU]', '')) / greatest({_LETTERS}, 1.0D)",
    "distinct_share": f"size(array_distinct(split(f.text, ''))) / {_LEN}",
    "dictionary_share": f"1 - length(regexp_replace(f.text, '(?i){'|'.join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w)))}', '')) / {_LEN}",
    "path_signs": f"length(regexp_replace(f.text, '[^/]', '')) / {_LEN} * 10",
    "in_path": r"IF(f.word RLIKE '://|^[.~/]|[\\\\]|[.](com|org|net|py|js|html?|png|jpe?g|txt)\\b', 1.0D, 0.0D)",
    "secret_before": f"IF(f.before RLIKE '{NAMED}', 1.0D, 0.0D)",
    "assigned": r"""IF(f.before RLIKE '[=:]\\s*["\\x27]?$', 1.0D, 0.0D)""",
    "other_near": f"IF(concat(f.before, ' ', f.after) RLIKE '(?i){OTHER_WORDS}', 1.0D, 0.0D)",
    "hex_only": "IF(f.text RLIKE '^([0-9a-f]+|[0-9A-F]+)$', 1.0D, 0.0D)",
    "password_before": "IF(f.before RLIKE '(?i)pass|pwd|secret', 1.0D, 0.0D)",
    "mark_share": f"length(regexp_replace(f.text, '[A-Za-z0-9]', '')) / {_LEN}",
    "space_share": f"length(regexp_replace(f.text, '[^ ]', '')) / {_LEN}",
    "code_signs": r"IF(f.text RLIKE '[(){}<>\\[\\]$|]|[A-Za-z_][.][A-Za-z_]|^[*.x]+$', 1.0D, 0.0D)",
    "in_url": "IF(f.before LIKE '://%', 1.0D, 0.0D)",
    "issuer": f"IF(f.text RLIKE '^({ISSUERS})', 1.0D, 0.0D)",
}


def findings(text: str, pattern: str = CANDIDATE) -> Column:
    """Array of runs of the text column with the words around them; empty for NULL."""
    return F.expr(_findings(text, pattern))


def _findings(text: str, pattern: str) -> str:
    word = lambda i: f"coalesce(get(words, {i}), '')"
    # words is bound by a one-element array, so the text is split once
    one = (f"struct(c AS text, concat({word('i - 2')}, ' ', {word('i - 1')}, ' ', substring_index({word('i')}, c, 1)) AS before, "
           f"{word('i')} AS word, {word('i + 1')} AS after)")
    of_word = f"transform(regexp_extract_all(words[i], '{pattern}', 0), c -> {one})"
    places = f"filter(sequence(0, size(words) - 1), i -> words[i] RLIKE '{pattern}')"
    found = f"flatten(transform(array(split(`{text}`, '{_sql(WHITE)}')), words -> flatten(transform({places}, i -> {of_word}))))"
    return f"CASE WHEN `{text}` RLIKE '{pattern}' THEN {found} ELSE CAST(array() AS {_KIND}) END"


def _assigned(text: str) -> str:
    """Values that a secret word and a sign introduce; the name and the sign are the words before them."""
    matches = (f"concat(regexp_extract_all(`{text}`, '{_sql(ASSIGNED)}', 1), "
               f"IF(length(`{text}`) > {VALUE_CHARS}, regexp_extract_all(`{text}`, '{_sql(ASSIGNED_LONG)}', 0), CAST(array() AS array<string>)))")
    split = f"transform({matches}, m -> struct(m, regexp_replace(m, '{_sql(_INTRODUCED)}', '') AS v))"
    named = f"transform({split}, p -> struct(left(p.m, length(p.m) - length(p.v)) AS before, p.v AS v))"
    # a value without quotes ends before the signs of its sentence
    parts = f"transform({named}, p -> struct(p.before, IF(ascii(right(p.before, 1)) IN (34, 39), p.v, TRIM(TRAILING '{_CLOSING}' FROM p.v)) AS v))"
    return _values(parts, 6)


def _in_urls(text: str) -> str:
    """Passwords of URLs; the scheme's end and the user are the words before them."""
    matches = f"regexp_extract_all(`{text}`, '{_sql(URL)}', 0)"
    at = "locate(':', m, 4)"
    return _values(f"transform({matches}, m -> struct(left(m, {at}) AS before, substr(m, {at} + 1) AS v))", 3)


def _values(parts: str, least: int) -> str:
    # what redaction has written is no value
    kept = f"filter({parts}, p -> length(p.v) >= {least} AND NOT contains('{MASK}', p.v))"
    return f"transform({kept}, p -> struct(p.v AS text, p.before AS before, p.v AS word, '' AS after))"


def candidates(text: str) -> Column:
    """All candidates of the text column: runs; issued runs, assigned values and passwords of URLs that are not among them."""
    runs = _findings(text, CANDIDATE)
    more = f"filter(concat({_findings(text, ISSUED)}, {_assigned(text)}, {_in_urls(text)}), a -> NOT exists(runs, r -> r.text = a.text))"
    return F.expr(f"CASE WHEN `{text}` IS NULL THEN CAST(array() AS {_KIND}) ELSE flatten(transform(array({runs}), runs -> concat(runs, {more}))) END")


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\")


class Forest:
    """A trained forest as SQL: the share of trees that vote for a secret, over the features of a finding ``g``."""

    def __init__(self, score: str):
        self.score = score

    def secrets(self, found: str) -> Column:
        """Distinct secrets among an array of findings, longest first. The features of a finding are computed once."""
        seen = ", ".join(f"CAST({sql} AS DOUBLE) AS {name}" for name, sql in FEATURES.items())
        judged = f"filter(transform({found}, f -> struct(f.text AS text, {seen})), g -> {self.score} >= {THRESHOLD})"
        kept = f"array_distinct(transform({judged}, g -> g.text))"
        return F.expr(f"array_sort({kept}, (a, b) -> CASE WHEN length(a) <> length(b) THEN length(b) - length(a) WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END)")


def train(labelled: DataFrame, rows: int = FIT_ROWS) -> Forest:
    """Forest from ``text, label`` (1: every candidate in the text is a secret, 0: none is)."""
    known = labelled.select("text", F.col("label").cast("double").alias("label")).dropna()
    each = known.select("label", F.explode(candidates("text")).alias("f"))
    table = each.select("label", *(F.expr(f"CAST({sql} AS DOUBLE)").alias(name) for name, sql in FEATURES.items()))
    # one ordered partition of at most ``rows`` rows: the same forest on any cluster
    sample = table.orderBy(F.xxhash64(*FEATURES, "label"), *FEATURES, "label").limit(rows).coalesce(1)
    sample = landed(labelled.sparkSession, sample, "findings")  # the fit reads it several times
    kinds = sorted(r.label for r in sample.select("label").distinct().collect())
    if len(kinds) < 2:
        return Forest(f"{kinds[0] if kinds else 1.0}D")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample).select("label", "features")
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=17, featureSubsetStrategy="onethird").fit(vectors)
    votes = " + ".join(_tree_sql(tree.toDebugString, "g.") for tree in model.trees)
    return Forest(f"(({votes}) / {TREES}D)")


def _tree_sql(printed: str, of: str = "") -> str:
    """One tree as nested conditions over the features ``of`` a finding, from its printed form."""
    lines = iter([line.strip() for line in printed.splitlines()[1:] if line.strip()])
    features = list(FEATURES)

    def node() -> str:
        line = next(lines)
        if line.startswith("Predict"):
            return f"{float(line.split(':')[1])}D"
        feature, bound = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        left = node()
        next(lines)  # Else
        return f"IF({of}{features[int(feature)]} <= {float(bound)!r}D, {left}, {node()})"

    return node()


def examples(spark: SparkSession, per_kind: int = 120) -> DataFrame:
    """Labelled findings of common kinds, made by rule: the start for a corpus without labelled ones."""
    h = "sha2(concat('seed', id), 256)"
    mixed = f"translate(base64(unhex({h})), '=+/', 'xYz')"
    word = lambda k: f"element_at(split('{' '.join(DICTIONARY)}', ' '), CAST(1 + pmod(xxhash64(id, {k}), {len(DICTIONARY)}) AS INT))"
    letters = f"translate({mixed}, '0123456789', 'qWzRkTvBnM')"
    syllables = lambda k: f"translate(substr(conv(substr(sha2(concat({k}, id), 256), 1, 12), 16, 10), 1, 3), '0123456789', 'bdfglmnprt')"
    made = lambda k: f"concat(substr({syllables(k)}, 1, 1), substr('aeiou', 1 + pmod(xxhash64(id, {k}), 5), 1), substr({syllables(k)}, 2, 1), substr('eaoui', 1 + pmod(xxhash64({k}, id), 5), 1), substr({syllables(k)}, 3, 1))"
    camel = f"concat({word(1)}, initcap({word(2)}), initcap({word(3)}), initcap({word(4)}), id % 97)"
    prose = f"concat({word(5)}, ' ', {word(6)}, ' ')"
    kinds = [
        (1, f"concat({prose}, 'token = \"', substr({h}, 1, 40), '\" ', {word(7)})"), (1, f"concat({prose}, 'AKIA', upper(substr({mixed}, 1, 16)), ' ', {word(7)})"),
        (1, f"concat({prose}, 'password=', substr({h}, 1, 18), ' ', {word(7)})"), (1, f"concat('api_key: ', substr({mixed}, 1, 32))"),
        (1, f"concat('Authorization: Bearer ', substr({mixed}, 1, 40))"), (1, f"concat('ghp_', substr({mixed}, 1, 36))"),
        (1, f"concat('client_secret = ', substr({mixed}, 1, 24))"),
        (1, f"concat({prose}, 'AKIA', upper(substr({letters}, 1, 16)), ' ', {word(7)})"), (1, f"concat('api_key=', substr({letters}, 1, 16), ' ', {word(7)})"),
        (1, f"concat('client_secret: \"', substr({letters}, 1, 24), '\"')"), (1, f"concat('password=', initcap({made(1)}), id % 10, {made(2)}, '&', id % 7)"),
        (1, f"concat('password=', substr({mixed}, 1, 6), '!', substr({mixed}, 7, 4))"), (1, f"concat('db_pass: ', {made(1)}, id % 10, {made(2)}, id % 10)"),
        (1, f"concat('passwd: ', {made(3)}, id % 1000)"), (1, f"concat('password = \"', concat_ws('-', {made(1)}, {made(2)}, {made(3)}, {made(4)}), '\"')"),
        (1, f"concat('pwd=\\'', {made(4)}, '#', upper({made(5)}), id % 100, '\\'')"), (1, f"concat('secret_key = \"', substr({mixed}, 1, 10), '%', substr({mixed}, 11, 12), '\"')"),
        (1, f"concat('postgres://', {made(1)}, ':', substr({mixed}, 1, 14), '@db.example.org/', {word(1)})"), (1, f"concat({prose}, 'amqp://', {word(1)}, ':', initcap({made(2)}), id % 1000, '@', {made(3)}, ':5672')"),
        (0, f"concat('https://', {word(1)}, ':', element_at(array('password', 'pass', '<password>', '$PASSWORD', 'xxxx', '***'), CAST(1 + id % 6 AS INT)), '@example.org/', {word(2)})"),
        (0, f"concat('password: ', {made(1)}, {word(1)}, ' ', {word(2)})"), (0, f"concat('key: ', {made(1)}, {made(2)}, ' ', {word(2)})"),
        (0, f"concat('author: ', initcap({made(1)}), {made(2)}, ' ', initcap({made(3)}))"), (0, f"concat('author = \"', initcap({made(4)}), ' ', initcap({made(5)}), '\"')"),
        (0, f"concat('token = ', {word(1)}, initcap({word(2)}), '()')"), (0, f"concat('password = ${{', upper({word(1)}), '_PASSWORD}}')"),
        (0, f"concat('password=', repeat(element_at(array('x', '*', '.'), CAST(1 + id % 3 AS INT)), CAST(6 + id % 9 AS INT)))"), (0, f"concat('secret = self.', {word(1)}, '_', {word(2)})"),
        (0, f"concat('password: ', {made(1)}, 'ed ', {word(2)})"), (0, f"concat('the key: \"', {made(1)}, ' ', {word(2)}, ' ', {made(3)}, ' ', {word(4)}, '\"')"),
        (0, f"concat('passenger: ', initcap({made(2)}), {made(4)}, ', ', {word(2)})"), (0, f"concat('keywords: ', {word(1)}, {word(2)}, ', ', {made(2)})"),
        (0, f"concat('login: https://www.example.org/', {word(1)}, '/', {word(2)})"), (0, f"concat('token: process.env.', upper({word(1)}), '_TOKEN')"),
        (0, f"concat({prose}, 'sk-', {word(1)}, '-', {word(2)}, '-', {word(3)}, '-', {word(4)})"), (0, f"concat('password = \"your-', {word(1)}, '-', {word(2)}, '\"')"),
        (0, f"concat('password: must ', 'password: contain', {word(1)})"), (0, f"concat('secret: the ', {word(1)}, ' secret = ', {made(1)}, {made(2)}, '.')"),
        (0, f"concat('commit ', substr({h}, 1, 40), ' ', {word(5)})"), (0, f"concat('md5 checksum ', substr({h}, 1, 32))"),
        (0, f"concat('https://www.example.org/', {word(1)}, '/', {word(2)}, '/', substr({h}, 1, 20))"), (0, f"concat('see /usr/lib/', {word(1)}, id % 9, '/', {word(2)}, '/', {word(3)}, '.py')"),
        (0, f"concat({prose}, {camel}, ' ', {word(7)})"), (0, f"concat({prose}, {word(1)}, '_', {word(2)}, '_', {word(3)}, '_', {word(4)}, '_', id % 50)"),
        (0, f"concat({prose}, initcap({made(1)}), initcap({made(2)}), initcap({made(3)}), id % 97, ' ', {word(7)})"), (0, f"concat('the ', {made(1)}, '_', {made(2)}, '-', {made(3)}, '/', {made(4)}, id % 50)"),
        (0, f"concat('uuid ', substr({h}, 1, 8), '-', substr({h}, 9, 4), '-', substr({h}, 13, 4), '-', substr({h}, 17, 12))"),
        (0, f"concat('order number ', 1000000000000000 + pmod(xxhash64(id), 900000000000000))"), (0, f"concat({prose}, repeat({word(1)}, 4), id % 7)"),
        (0, f"concat('token = \"your-', {word(1)}, '-token-here-', id % 1000, '\"')"), (0, f"concat('password=', repeat('x', 16), id % 10)"),
        (0, f"concat({prose}, '2024-0', 1 + id % 9, '-1', id % 10, 'T10-1', id % 10, '-00 ', {word(7)})"), (0, f"concat('version ', {word(1)}, '-', {word(2)}, '-', id % 20, '-', id % 7, '-', id % 5, '-snapshot')"),
    ]
    cases = " ".join(f"WHEN {k} THEN {sql}" for k, (_, sql) in enumerate(kinds))
    labels = ", ".join(str(label) for label, _ in kinds)
    n = len(kinds)
    made_up = spark.range(per_kind * n).selectExpr(f"CASE id % {n} {cases} END AS text", f"element_at(array({labels}), CAST(id % {n} AS INT) + 1) AS label")
    return landed(spark, made_up, "examples")  # else every use of a text in an expression would make it anew


def scan(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, n_candidates, n_secrets, secret_hashes (SHA-256 of each, longest first), redacted_sha256 of the redacted text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("found", candidates("text"))
    rows = rows.withColumn("secrets", forest.secrets("found"))
    return rows.select(
        "doc_id", F.size("found").alias("n_candidates"), F.size("secrets").alias("n_secrets"),
        F.expr("concat_ws(',', transform(secrets, s -> sha2(s, 256)))").alias("secret_hashes"),
        F.sha2(_masked("text", "secrets"), 256).alias("redacted_sha256"))


def _masked(text: str, secrets: str) -> Column:
    """Every place of a secret is masked, but not where it is a part of a longer word."""
    own = r"regexp_replace(s, '[^A-Za-z0-9]', '\\\\$0')"
    edge = lambda end, look: f"IF({end}(s, 1) RLIKE '[A-Za-z0-9]', '{look}', '')"
    pattern = f"concat({edge('left', '(?<![A-Za-z0-9])')}, {own}, {edge('right', '(?![A-Za-z0-9])')})"
    return F.expr(f"aggregate(`{secrets}`, `{text}`, (t, s) -> regexp_replace(t, {pattern}, '{MASK}'))")


def redact(docs: DataFrame, forest: Forest) -> DataFrame:
    """All rows and columns, with the secrets in ``text`` masked and ``n_chars`` of changed texts counted anew."""
    name = f"secrets_{uuid.uuid4().hex}"
    rows = docs.withColumn(f"{name}_found", candidates("text")).withColumn(name, forest.secrets(f"{name}_found"))
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars")]
    masked = _masked("text", name)
    by_name = {c: F.col(f"`{c}`") for c in docs.columns}
    by_name["text"] = masked.alias("text")
    if "n_chars" in by_name:
        by_name["n_chars"] = F.when(F.size(name) > 0, F.length(masked)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return rows.select(*by_name.values())
