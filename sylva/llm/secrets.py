"""Secret scans: candidates by pattern, false positives removed by a random forest, in DataFrame functions alone.

A candidate is a run of 16 key characters or more, or 6 characters or more after an assignment to a name that ends in
one of GOOD_WORDS (also quoted, as in JSON). Its features are its length, shares of character classes and of long
runs of consonants, transitions between classes per character, the share of it that known word pieces cover,
whether it stands in a path or URL or refers to a variable, and which words stand around it.
The forest is trained by Spark's ML library on labelled findings, LABELLED of them at most (a bound that does
not grow with the corpus), and compiled into one expression of nested conditions; scoring is a projection,
without a shuffle.

Null and empty texts: no candidates. Repeated rows are scanned alike. Empty table: empty result. Other columns
stay; columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .matches import found, joined, let

#: Labelled findings for training, at most.
LABELLED = 4000
TREES, DEPTH = 16, 6
LEAST_SCORE = 0.5
AROUND = 48
#: What candidates look like, and words and word pieces.
GOOD_WORDS = "api apikey auth authorization aws bearer client_secret cred credential key passphrase passwd password private pwd secret sig signature token webhook"
_QUOTE = "[\"'`]?"
#: The letters that names begin with are looked at first: most places are passed over by that.
_INITIALS = "".join(sorted({w[0] + w[0].upper() for w in GOOD_WORDS.split()}))
_NAME = f"(?=[{_INITIALS}])(?i:passw(?:or)?d|{'|'.join(GOOD_WORDS.split())}){_QUOTE}"
#: An assignment within a value, which is a candidate of its own.
_INNER = rf"[\"'`]?[A-Za-z0-9_.-]{{0,32}}?{_NAME} ?[=:][^\s=]"
ASSIGNMENT = rf"{_NAME}[ \t]{{0,4}}+(?:[=:]>|:=|={{1,3}}+|:)[ \t]{{0,4}}+[\"'`]?+(?i:(?:bearer|basic) )?+"
#: What follows an assignment: up to the closing quote (with blanks, if no other candidate stands in it), or up to a blank, bracket or quote.
_QUOTED = "|".join(
    rf"(?<={q})(?:(?:[^{q}\\\s&;,]|[&;,](?!{_INNER})|\\\S){{6,}}+|(?:(?!(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{{16}}|{_INNER}))[^{q}\\\r\n]|\\[^\r\n]){{6,}}+)(?={q})" for q in "\"'`"
)
VALUE = rf"(?!{_INNER})(?:{_QUOTED}|[^\s\"'<>&;,]{{6,}}+(?=;[A-Za-z_][A-Za-z0-9_.-]{{0,64}}=)|(?:[^\s\"'<>&;,]|[;,](?!{_INNER})|&(?![A-Za-z_][A-Za-z0-9_.-]{{0,64}}=)){{6,}}+)"
#: A run of key characters, unless it is the name of an assignment itself.
_RUN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}+(?!(?<={_NAME.removesuffix(_QUOTE)}){_QUOTE}(?:[ \t]{{0,4}}(?:[=:]>|:|=(?!=))|[ \t]{{1,4}}=)[ \t]{{0,4}}[^\s=])={{0,2}}"
#: An armoured block is one candidate, from its first line to its last.
_BLOCK = r"-----BEGIN [A-Z0-9 ]{3,40}-----(?:[^-]|-(?!----))*+-----END [A-Z0-9 ]{3,40}-----"
CANDIDATE = f"{_BLOCK}|{ASSIGNMENT}{VALUE}|{_RUN}"
#: The printable characters of ASCII, of which a candidate may hold so many different ones.
PRINTABLE = [chr(c) for c in range(33, 127)]
BAD_WORDS = "blob checksum commit digest dummy etag example fake fingerprint guid hash id image img integrity isbn md5 object placeholder rev revision sample serial sha sha1 sha256 sha512 test trace tree uuid version"
PIECES = "tion ation ing ment able heit keit lich ung sch ein ver ber ge que eau ier ent ement eux ado mente cion idad para como with that this from have your word name data file test user example sample dummy change placeholder image index static public source version document config default value null none true false http www com org net"
SYLLABLES = "ba ke lo mi nu ra se ti wo ha de fo gu la me ni po ru sa te vi ya zo an er in on un est und tra pre str cht sch ight all ock"
FEATURES = ("length", "digits", "uppers", "marks", "transitions", "distinct", "hexlike", "covered", "in_path", "uuid", "assigned", "good", "bad",
    "quoted", "consonants", "spelled", "refers", "private")


def _words(s: str) -> str:
    return "|".join(s.split())


def features(hit: Column) -> dict[str, Column]:
    """Features of a struct of (before, match, after)."""
    m, before, after = hit["match"], F.right(hit["before"], F.lit(AROUND)), F.left(hit["after"], F.lit(AROUND))
    n = F.greatest(F.length(m), F.lit(1)).cast("double")
    gone = lambda p: (F.length(m) - F.length(F.regexp_replace(m, p, ""))) / n
    near = F.right(before, F.lit(32))
    flag = lambda c: c.cast("double")
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    shapes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "[A-Z]+", "\u0001"), "[a-z]+", "\u0002"), "[0-9]+", "\u0003"), "[^\u0001-\u0003]+", "\u0004")
    return {
        "length": n, "digits": gone("[0-9]"), "uppers": gone("[A-Z]"), "marks": gone("[^A-Za-z0-9]"), "transitions": (F.length(shapes) - 1) / n,
        "distinct": F.size(F.filter(F.array(*map(F.lit, PRINTABLE)), lambda c: F.contains(m, c))) / F.least(n, F.lit(64.0)),
        "hexlike": flag(m.rlike("^[0-9a-f]+$|^[0-9A-F]+$")), "covered": gone(f"(?i:{_words(PIECES)})"),
        "in_path": flag(before.rlike(r"[/\\.@:][A-Za-z0-9._%-]*[/\\?&=]$|[/\\]$") | m.rlike("^/|/[a-z]+/[a-z]+")) + flag(
        after.rlike(r"^[/.][a-z]{2,4}\b")), "uuid": flag(m.rlike("^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$")),
        "assigned": flag(before.rlike(r"[=:]>?[ \t]{0,4}[\"'`]?$|(?i:bearer|basic)\s$")),
        "good": number(F.regexp_count(near, F.lit(f"(?i)(?<![a-z])(?:[a-z]+_)?(?:{_words(GOOD_WORDS)})(?![a-z])"))),
        "bad": number(F.regexp_count(near, F.lit(f"(?i)(?<![a-z])(?:{_words(BAD_WORDS)})(?![a-z])"))),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "consonants": gone("(?i:[bcdfghjklmnpqrstvwxz]{4,})"),
        "spelled": flag(m.rlike(r"^[\p{L} .,:;!?'_/-]*+$") & ~m.rlike("[a-z][A-Z]+[a-z]|[A-Z]{2}[a-z]")),
        "refers": flag(m.rlike(r"^(?:[$%]?[{(]|<|\*{3}|[$%][A-Za-z_]+%?$|[A-Za-z_.]+[(\[]|(.)\1+$)")),
        "private": flag(m.rlike("^-----BEGIN [A-Z0-9 ]*PRIVATE")),
    }


def labelled_findings(spark: SparkSession, n: int = LABELLED) -> DataFrame:
    """before, match, after, label: findings made by rule, secrets and false positives in the places they are met."""
    return spark.range(0, n, 1, 1).select(let(F.col("id"), _labelled).alias("r")).select("r.*")


def _labelled(i: Column) -> Column:
    """The labelled finding of number i."""
    hexes = lambda salt: F.sha2(F.concat(i.cast("string"), F.lit(salt)), 256)
    b64 = lambda salt: F.regexp_replace(F.base64(F.unhex(hexes(salt))), "[\r\n=]", "")
    pick = lambda salt, words: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(words))) + 1).cast("int"))
    r = lambda salt, k: F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(k)).cast("int")
    word = lambda salt: pick(salt, PIECES.split())
    run = lambda salt: F.concat(word(salt + "1"), word(salt + "2"), word(salt + "3"), word(salt + "4"), word(salt + "5"))
    spoken = lambda salt, k: F.concat(*[pick(f"{salt}{j}", SYLLABLES.split()) for j in range(k)])
    mark = lambda salt: pick(salt, "! $ % & * # @ ? - _ +".split())
    prose = F.concat(word("p1"), F.lit(" "), word("p2"), F.lit(", "), word("p3"), F.lit(" "))
    letters = lambda c: F.translate(c, "0123456789+/", "QxWkZjVqXbKz")
    secret = F.element_at(F.array(F.left(hexes("s"), F.lit(40)), F.left(hexes("s"), F.lit(32)), hexes("s"), F.left(b64("s"), F.lit(40)),
        F.left(b64("s"), F.lit(24)), F.concat(F.lit("AKIA"), F.upper(F.left(F.translate(b64("s"), "+/", "QZ"), F.lit(16)))),
        F.concat(F.lit("ghp_"), F.left(F.translate(b64("s"), "+/", "aZ"), F.lit(36))),
        F.concat(F.lit("sk-"), F.left(F.translate(b64("s"), "+/", "aZ"), F.lit(40))), letters(F.left(b64("s"), F.lit(40))),
        letters(F.left(b64("s"), F.lit(24))), F.concat(F.lit("AKIA"), F.upper(letters(F.left(b64("s"), F.lit(16)))))), r("kind", 11) + 1)
    name = pick("name", ["token", "api_key", "secret", "password", "key", "auth_token", "client_secret", "access_key", "credential", "TOKEN",
        "Secret", "apikey", "pwd", "passwd", "passphrase", "private_key", "credential", "auth"])
    into = pick("into", [' = "', "=", ": ", " = ", ': "', "='", '="', '": "', '":"'])
    # passwords, which are met after an assignment alone
    short = F.element_at(F.array(
        F.left(F.translate(b64("w"), "+/", "$!"), r("wn", 9) + 8), F.left(F.translate(hexes("w"), "abcdef", "xyzwqk"), r("wn", 5) + 8),
        F.concat(spoken("w", 2), r("wd", 10).cast("string"), F.left(letters(F.lower(b64("v"))), F.lit(3))),
        F.concat(spoken("w", 2), r("wd", 9999).cast("string"), mark("wm")),
        F.concat(F.initcap(spoken("w", 2)), mark("wm"), spoken("v", 2), mark("wx"), r("wd", 99).cast("string")),
        F.concat(F.left(b64("w"), F.lit(5)), mark("wm"), F.left(b64("v"), F.lit(5))),
    ), r("wk", 6) + 1)
    told = F.when(r("short", 4) == 0, short).otherwise(secret)
    armoured = lambda name, salt: F.concat(F.lit("-----BEGIN "), name, F.lit("-----\n"), b64(salt), F.lit("\n"),
        F.repeat(F.concat(b64(salt + "1"), b64(salt + "2"), F.lit("\n")), r(salt, 30) + 1), F.lit("-----END "), name, F.lit("-----"))
    yes = F.struct(F.concat(prose, name, into).alias("before"), told.alias("match"),
        F.when(F.right(into, F.lit(1)) == '"', F.lit('" ')).when(F.right(into, F.lit(1)) == "'", F.lit("' ")).otherwise(F.lit(" ")).alias("after"),
        F.lit(1.0).alias("label"))
    armour = F.struct(F.concat(prose, F.lit("\n")).alias("before"),
        armoured(pick("pk", ["RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY", "ENCRYPTED PRIVATE KEY"]),
        "pm").alias("match"), F.lit("\n").alias("after"), F.lit(1.0).alias("label"))
    bare = F.struct(F.concat(prose, pick("b", ["bearer ", "Authorization: Bearer ", "my key ", "the token ", "use secret "])).alias("before"),
        secret.alias("match"), F.lit(" ").alias("after"), F.lit(1.0).alias("label"))
    uuid = F.concat_ws("-", F.substr(hexes("u"), F.lit(1), F.lit(8)), F.substr(hexes("u"), F.lit(9), F.lit(4)),
        F.substr(hexes("u"), F.lit(13), F.lit(4)), F.substr(hexes("u"), F.lit(17), F.lit(4)), F.substr(hexes("u"), F.lit(21), F.lit(12)))
    no = lambda before, match, after=" ": F.struct(F.concat(prose, before).alias("before"), match.alias("match"), F.lit(after).alias("after"),
        F.lit(0.0).alias("label"))
    false = F.element_at(F.array(
        no(pick("n1", ["commit ", "sha1: ", "sha256: ", "md5 ", "revision ", "checksum = ", "etag: ", "hash="]),
        F.element_at(F.array(F.left(hexes("n"), F.lit(40)), hexes("n"), F.left(hexes("n"), F.lit(32))), r("nk", 3) + 1)),
        no(pick("n2", ["id = ", "uuid: ", "guid=", "", "trace ", "request id "]), uuid),
        no(F.lit("https://www.example.com/static/"), F.concat(run("a"), F.lit("/"), run("b"), r("d", 999).cast("string")), ".html "),
        no(pick("n4", ["", "token = ", "password: ", "api_key="]), F.concat(run("c"), r("d", 99).cast("string"))),
        no(F.lit(""), F.concat_ws("-", word("x"), run("e"), word("y"), r("d", 9999).cast("string"))),
        no(pick("n6", ["key = ", "token: ", "secret="]),
        pick("n6m", ["your_api_key_here_1", "xxxxxxxxxxxxxxxxxxxx0", "example-token-0000000", "changeme1234567890ab", "00000000000000000000",
        "placeholder_secret_1", "test_test_test_test1", "1234567890123456"])),
        no(F.lit(""), F.lpad(F.abs(F.xxhash64(i)).cast("string"), 16, "4")),
        no(pick("n8", ["image ", "object ", "blob "]), F.left(b64("m"), F.lit(40))),
        no(pick("n9", ["", "serial ", "isbn ", "phone "]), F.left(F.translate(hexes("q"), "abcdef", "012345"), F.lit(18))),
        no(F.concat(name, into), F.concat(spoken("A", 3), pick("nA", ["", "", ".", ",", ";"]))),
        no(F.concat(name, pick("nB", [": ", ":", " = "])), F.initcap(F.concat(spoken("A", 2), word("nB2"), word("nB3")))),
        no(F.concat(name, into), pick("nC", ["required", "disabled", "enabled", "optional", "undefined", "localhost", "changeme", "string,",
        "default", "function"])),
        no(F.concat(name, pick("nD", [' = "', '": "'])), F.concat_ws(" ", F.initcap(spoken("A", 2)), word("nD1"), spoken("D", 3), word("nD2"), spoken("E", 2)), '" '),
        no(F.concat(name, into), F.concat(pick("nE", ["${", "{{ ", "$", "%(", "get_", "self.", "config.", "os.environ["]), pick("nEc",
        "DB_PASSWORD API_KEY token secret_key user_token SECRET value_of_it".split()), pick("nEe", ["", "}", "(request)", "]", ")s"]))),
        no(F.concat(name, into), F.repeat(pick("nF", ["*", "x", ".", "-", "X"]), r("nFn", 20) + 6)),
        no(F.lit(""), F.concat(F.initcap(spoken("A", 4)), word("nG"), word("nH"))),
        no(F.lit(""), F.upper(F.concat(spoken("A", 4), word("nG"), word("nH")))),
        no(F.lit(""), F.replace(F.concat_ws("-", spoken("A", 2), word("nI1"), spoken("B", 3), word("nI2")), F.lit("-"), pick("nI", ["-", "_",
        "/"]))), no(F.lit(""), F.concat(spoken("A", 2), F.initcap(spoken("B", 3)), F.initcap(word("nJ")), F.initcap(spoken("C", 2)))),
        no(F.lit(""), F.repeat(pick("nK", ["-", "_", "=", "a", "O"]), r("nKn", 60) + 16)),
        no(F.lit(""), F.concat(run("nL"), pick("nL6", ["", "lich"]))),
        no(F.lit("arn:aws:"), F.concat(F.lit("iam::"), F.lpad(F.abs(F.xxhash64(i)).cast("string"), 12, "4"), F.lit(":"), spoken("A", 2), F.lit("/"), spoken("B", 2))),
        no(F.lit("\n"), armoured(pick("ck", ["CERTIFICATE", "PUBLIC KEY", "RSA PUBLIC KEY", "CERTIFICATE REQUEST", "PGP SIGNATURE"]), "cm"), "\n"),
        no(F.lit(""), F.left(hexes("z"), F.lit(32))),
        no(F.lit("/usr/lib/"), F.concat(run("g"), F.lit("/lib"), run("h"), r("d", 99).cast("string")), ".so "),
        no(F.lit(""), F.concat(run("k"), run("l"), r("d", 9).cast("string"))),
    ), r("false", 26) + 1)
    return F.when(F.pmod(i, F.lit(2)) == 0, F.when(r("bare", 5) == 0, bare).when(r("armour", 25) == 0, armour).otherwise(yes)).otherwise(false)


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 7):
    """A random forest over FEATURES for findings with a label."""
    x = labelled.select("label", F.struct("before", "match", "after").alias("h"))
    x = x.select("label", *[c.alias(k) for k, c in features(F.col("h")).items()])
    x = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(x)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", maxMemoryInMB=64).fit(x)


def compiled(model):
    """A function from a struct of FEATURES to the share of trees that vote secret, as one expression."""

    def tree(node):
        if "LeafNode" in node.getClass().getSimpleName():
            return float(node.prediction())
        split = node.split()
        left, right = tree(node.leftChild()), tree(node.rightChild())
        return left if left == right else (FEATURES[split.featureIndex()], float(split.threshold()), left, right)

    trees = [tree(t._call_java("rootNode")) for t in model.trees]

    def expression(t, f: Column) -> Column:
        return F.lit(t) if isinstance(t, float) else F.when(f[t[0]] <= t[1], expression(t[2], f)).otherwise(expression(t[3], f))

    def score(f: Column) -> Column:
        total = expression(trees[0], f)
        for t in trees[1:]:
            total = total + expression(t, f)
        return total / len(trees)

    return score


def _bare(hit: Column) -> Column:
    """The hit with what assigns the candidate moved to the text before it."""
    head = F.regexp_extract(hit["match"], f"^{ASSIGNMENT}", 0)
    return let(head, lambda p: F.struct(F.concat(hit["before"], p).alias("before"), F.substr(hit["match"], F.length(p) + 1).alias("match"), hit["after"].alias("after")))


def scan(docs: DataFrame, model=None, labelled: DataFrame | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """docs with findings, an array of (before, match, after, score, secret)."""
    spark = docs.sparkSession
    score = compiled(model or train(labelled if labelled is not None else labelled_findings(spark)))
    keep = common.others(docs.columns, ("findings",))
    none = F.array().cast("array<struct<before:string,match:string,after:string>>")
    text = F.coalesce(docs["text"], F.lit(""))
    hits = F.when(text.rlike(CANDIDATE), F.transform(found(text, CANDIDATE), _bare)).otherwise(none)
    x = docs.select(common.held(docs, keep), hits.alias("_hits"))
    made = lambda h: F.struct(*[c.alias(k) for k, c in features(h).items()])
    x = x.withColumn("_features", F.transform("_hits", made))
    x = x.withColumn("_scores", F.transform("_features", score))
    out = lambda h, s: F.struct(h["before"].alias("before"), h["match"].alias("match"), h["after"].alias("after"), s.alias("score"), (s >= least).alias("secret"))
    return x.withColumn("findings", F.zip_with("_hits", "_scores", out)).select(*common.released(keep), "findings")


def redact(docs: DataFrame, mark: str = "<secret>", **how) -> DataFrame:
    """docs with a mark in place of each secret."""
    others = [c for c in docs.columns if c != "text"]
    x = scan(docs.select("text", common.held(docs, others)), **how)
    new = F.transform("findings", lambda f: F.when(f["secret"], F.lit(mark)).otherwise(f["match"]))
    secret = F.exists("findings", lambda f: f["secret"])
    return x.withColumn("text", F.when(secret, joined(F.col("findings"),
        new)).otherwise(F.col("text"))).select(*[F.col("text") if c == "text" else common.released([c])[0] for c in docs.columns])
