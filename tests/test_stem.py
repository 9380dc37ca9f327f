from pyspark.sql import functions as F

from contentspark.functions.binding import let_sql
from contentspark.functions.stem import common_start, stem_snowball
from contentspark.functions.text import stemmer, words

ENGLISH = {
    "consign": "consign", "consigned": "consign", "consignment": "consign", "consist": "consist", "consisted": "consist",
    "consistency": "consist", "consistently": "consist", "consolation": "consol", "consolatory": "consolatori",
    "console": "consol", "consolidate": "consolid", "consolidating": "consolid", "consolingly": "consol",
    "conspicuous": "conspicu", "conspiracy": "conspiraci", "conspirators": "conspir", "constables": "constabl",
    "constance": "constanc", "constancy": "constanc", "knackeries": "knackeri", "knaves": "knave", "knavish": "knavish",
    "kneaded": "knead", "knee": "knee", "kneeling": "kneel", "knightly": "knight", "knitted": "knit", "knives": "knive",
    "knocker": "knocker", "architecture": "architectur", "vector": "vector", "generate": "generat", "general": "general",
    "skies": "sky", "dying": "die", "news": "news", "inning": "inning", "proceed": "proceed", "ties": "tie", "cries": "cri",
    "gas": "gas", "gaps": "gap", "kiwis": "kiwi", "agreed": "agre", "feed": "feed", "hoping": "hope", "hopping": "hop",
    "luxuriated": "luxuri", "happy": "happi", "say": "say", "by": "by", "youth": "youth", "boyish": "boyish",
    "relational": "relat", "apology": "apolog", "rationally": "ration", "hopefulness": "hope", "adoption": "adopt",
    "sensational": "sensat", "running": "run", "controlling": "control", "rate": "rate", "a": "a", "is": "is",
    "microservices": "microservic", "boot": "boot", "spring": "spring", "java": "java", "21": "21", "kubernetes": "kubernet",
}
RUSSIAN = {
    "в": "в", "вавиловка": "вавиловк", "вагнера": "вагнер", "вагон": "вагон", "вагонов": "вагон", "вагоном": "вагон",
    "важная": "важн", "важнее": "важн", "важнейшие": "важн", "важнейшими": "важн", "важничал": "важнича", "важно": "важн",
    "важного": "важн", "важностью": "важност", "вазах": "ваз", "пава": "пав", "павел": "павел", "павильонам": "павильон",
    "павлиний": "павлин", "павлиньи": "павлин", "павлович": "павлович", "пагода": "пагод", "падает": "пада",
    "падаль": "падал", "падать": "пада", "падающего": "пада", "падаю": "пада", "разработка": "разработк",
    "разработки": "разработк", "разработке": "разработк", "ёлка": "елк", "рядовой": "рядов",
}


def test_published_samples(spark):
    for samples in (ENGLISH, RUSSIAN):
        rows = spark.createDataFrame([(w,) for w in samples], "word string")
        got = {r.word: r.stem for r in rows.select("word", F.expr(stem_snowball("word")).alias("stem")).collect()}
        assert {w: s for w, s in got.items() if s != samples[w]} == {}


def test_words_begin_like_their_lexeme(spark, small):
    seen = spark.read.parquet(f"{small}/documents.parquet").select(F.explode(words(F.col("text"))).alias("word"))
    samples = spark.createDataFrame([(w,) for w in [*ENGLISH, *RUSSIAN]], "word string")
    for stem in ("none", "light", "snowball"):
        start = F.expr(f"replace({let_sql('q', stemmer(stem)('word'), common_start('q'))}, 'ё', 'е')")
        every = samples.union(seen.distinct()).select("word", start.alias("start"))
        assert every.where(~F.replace("word", F.lit("ё"), F.lit("е")).startswith(F.col("start"))).collect() == []
