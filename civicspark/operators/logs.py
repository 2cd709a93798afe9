"""Access-log reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The shapes of a line, with any request and with a well-formed one.
LINE = r'^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\.\d+ \+\d{4} \w+ \[web-\d+\] ([0-9.]+):\d+ - "([^"]*)" (\d+)'
PAGE_LINE = r'^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\.\d+ \+\d{4} \w+ \[web-\d+\] ([0-9.]+):\d+ - "(\w+ [^"]*) HTTP/1\.[01]" (\d+)'

#: Status, parts that the request must hold (all of the first, any of the second), and the name of the class.
CLASSES = [
    (404, [], ["/favicon.ico", "/apple-touch-icon", "/static/"], "Ressources statiques manquantes"),
    (404, [], ["wp-", ".php", ".env", "phpinfo"], "Tentatives d'intrusion"),
    (404, [], ["answers/", "questions/"], "Pages de contenu introuvables"),
    (404, [], [], "Pages 404 diverses"),
    (500, ["/forms/", "/dashboard"], [], "Erreurs dashboard formulaires"),
    (500, ["/search/"], [], "Erreurs de recherche"),
    (500, [], [], "Erreurs serveur diverses"),
    (408, ["/search/"], [], "Timeouts de recherche"),
    (408, [], [], "Timeouts divers"),
    (405, [], [], "Méthodes HTTP non autorisées"),
]


def parse(lines: DataFrame, column: str = "value", shape: str = LINE) -> DataFrame:
    """ts, ip, request, method, path, status of each line of a shape; other lines go."""
    part = lambda i: F.regexp_extract(column, shape, i)
    out = lines.where(F.col(column).rlike(shape)).select(F.to_timestamp(part(1), "yyyy-MM-dd HH:mm:ss").cast("timestamp_ntz").alias("ts"), part(2).alias("ip"), part(3).alias("request"), part(4).cast("int").alias("status"))
    return out.withColumn("method", F.split_part("request", F.lit(" "), F.lit(1))).withColumn("path", F.split_part("request", F.lit(" "), F.lit(2)))


def error_category(status: Column, request: Column, classes: list = CLASSES, other: str = "Erreurs ") -> Column:
    """The first class of the table that fits; else a name made of the status."""
    out = F.concat(F.lit(other), status.cast("string"))
    for code, every, some, name in reversed(classes):
        fits = status == code
        for p in every:
            fits = fits & F.contains(request, F.lit(p))
        if some:
            fits = fits & F.exists(F.array(*map(F.lit, some)), lambda p: F.contains(request, p))
        out = F.when(fits, F.lit(name)).otherwise(out)
    return out


def is_page(method: Column, path: Column, status: Column) -> Column:
    return (method == "GET") & (status == 200) & ~F.startswith(path, F.lit("/static/"))


def is_bot(ip: Column, bots: list[str]) -> Column:
    return ip.isin(*bots) if bots else F.lit(False)


def hourly(df: DataFrame, ts: str = "ts", who: str = "ip") -> DataFrame:
    """Requests and distinct visitors by hour."""
    return df.groupBy(F.date_format(ts, "yyyy-MM-dd HH").alias("hour")).agg(F.count("*").alias("requests"), F.count_distinct(F.col(who)).alias("visitors"))


def top(df: DataFrame, by: Column, name: str, n: int = 10) -> DataFrame:
    return df.groupBy(by.alias(name)).agg(F.count("*").alias("requests")).orderBy(F.desc("requests"), name).limit(n)


def shares(df: DataFrame, by: Column, name: str) -> DataFrame:
    """Rows by class, and the percentage of all."""
    counts = df.groupBy(by.alias(name)).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return counts.withColumn("percentage", F.round(F.col("count").cast("decimal(20,0)") * 100 / total, 2).cast("double"))


def samples(df: DataFrame, by: str, order: list, n: int = 5) -> DataFrame:
    """The first n rows of each class."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)


def visitor_report(requests: DataFrame, bots: list[str] = ()) -> DataFrame:
    """One row: lines, visitors, page views, bots' and others' requests."""
    bot = is_bot(F.col("ip"), list(bots))
    return requests.agg(F.count("*").alias("requests"), F.count_distinct(F.col("ip")).alias("visitors"), F.count_if(is_page(F.col("method"), F.col("path"), F.col("status"))).alias("page_views"), F.count_if(bot).alias("bot_requests"), F.count_if(~bot).alias("human_requests"))
