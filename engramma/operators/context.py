"""What a message calls for, what fits a token budget, and what the decision log says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramma.functions.text import estimated_tokens, plain
from engramma.sources.snapshots import parse_log

#: Fixed values of the policy.
VOLUNTEER_SCORE, VOLUNTEER_SIM, UPDATE_SCORE = 0.10, 0.18, 0.12
CLEAR = r"(?i)(^|\s)(qué|quién|cuándo|dónde|cómo|cuál|por qué|recuerdas|te acuerdas|sabes si|do you (recall|remember))\b"
DOUBTFUL = r"(?i)(^|\s)(que|quien|cuando|donde|como|cual|por que|what|who|when|where|which|why|how)\b"
CREATIVE = r"(?i)\b(se me ocurre|no s[eé] c[oó]mo|estoy atascad[oa]|alguna idea|ideas para|y si|se te ocurre|inspiraci[oó]n|lluvia de ideas|brainstorm|stuck|any ideas|what if|inspiration)\b"
AFFIRMS = r"(?i)\b(me llamo|soy |prefiero|me gusta|odio|uso |trabajo en|vivo en|mi |recuerda que|apunta que|ten en cuenta que|i (am|prefer|use|like|hate)|my name is|remember that|note that)\b"


def certainty(text: Column) -> Column:
    """clear, doubtful or null: how surely a message asks something."""
    return F.when(text.rlike("[?¿]") | text.rlike(CLEAR), "clear").when(text.rlike(DOUBTFUL), "doubtful")


def intent(text: Column) -> Column:
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty").when(text.rlike(CREATIVE), "creative").when(certainty(text).isNotNull(), F.concat(F.lit("question_"), certainty(text))).when(text.rlike(AFFIRMS), "affirms").otherwise("other")


def decide(messages: DataFrame, hits: DataFrame, musings: DataFrame | None = None) -> DataFrame:
    """(query_id, action, n_hits) for messages (query_id, text), given recall hits and creative finds."""
    best = hits.groupBy("query_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("act") >= VOLUNTEER_SIM).alias("n_sim"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"),
        F.count_if((F.col("score") >= VOLUNTEER_SCORE) & (F.col("act") >= VOLUNTEER_SIM)).alias("n_volunteer"),
    )
    ideas = musings.groupBy("query_id").agg(F.count("*").alias("ideas")) if musings is not None else None
    rows = messages.withColumn("intent", intent(F.col("text"))).withColumn("sure", certainty(F.col("text"))).join(best, "query_id", "left")
    rows = rows.join(ideas, "query_id", "left") if ideas is not None else rows.withColumn("ideas", F.lit(None).cast("long"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    muses = (F.col("intent") == "creative") & (none("ideas") > 0)
    asks = F.col("sure").isNotNull()
    affirms = F.col("text").rlike(AFFIRMS)
    n = F.when(muses, none("ideas")).when(F.col("sure") == "clear", none("n")).when(asks, none("n_sim")).when(affirms, F.lit(0)).otherwise(none("n_volunteer"))
    found = F.when(n > 0, "recall").otherwise("nothing")
    claim = F.when(F.coalesce(F.col("top") >= UPDATE_SCORE, F.lit(False)), "update?").otherwise("remember?")
    action = F.when(F.col("intent") == "empty", "nothing").when(muses, "muse").when(asks, found).when(affirms, claim).otherwise(found)
    return rows.select("query_id", "intent", action.alias("action"), F.when(F.col("intent") == "empty", 0).otherwise(n).cast("long").alias("n_hits"))


#: What stands for lines that do not fit: number left out, budget. Its length is reserved.
NOTICE = "({} more memories do not fit the budget of {} tokens; ask for them if needed)"


def fit_budget(lines: DataFrame, budget: int, notice_text: str = NOTICE) -> DataFrame:
    """(key, kept, omitted, tokens) for (key, lines): the header always, then whole lines while they fit; the notice is reserved for.

    A fold over each array, since a line that is too long is passed over and a later one may fit.
    """
    cost = F.transform("lines", lambda s: estimated_tokens(s))
    total = F.aggregate(cost, F.lit(0), lambda a, c: a + c)
    lead, middle, tail = notice_text.split("{}")
    notice = lambda n: F.concat(F.lit(lead), n.cast("string"), F.lit(f"{middle}{budget}{tail}"))
    rows = lines.select("key", "lines", cost.alias("cost"), total.alias("total"))
    cap = F.greatest(F.lit(0), F.lit(budget) - estimated_tokens(notice(F.greatest(F.lit(1), F.size("lines") - 1))))
    start = F.struct(F.lit(0).alias("spent"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, i: Column) -> Column:
        c = F.col("cost")[i]
        fits = (i == 0) | (acc["spent"] + c <= F.col("cap"))
        return F.struct(F.when(fits, acc["spent"] + c).otherwise(acc["spent"]).alias("spent"), F.when(fits, F.concat(acc["kept"], F.array(i))).otherwise(acc["kept"]).alias("kept"))

    folded = rows.withColumn("cap", cap).withColumn("f", F.aggregate(F.sequence(F.lit(0), F.size("lines") - 1), start, step))
    whole = (F.col("total") <= budget) | F.lit(budget <= 0)
    omitted = F.when(whole, 0).otherwise(F.size("lines") - F.size("f.kept"))
    tokens = F.when(whole, F.col("total")).otherwise(F.col("f.spent") + F.when(omitted > 0, estimated_tokens(notice(omitted))).otherwise(0))
    kept = F.when(whole, F.col("lines")).otherwise(F.concat(F.transform("f.kept", lambda i: F.col("lines")[i]), F.when(omitted > 0, F.array(notice(omitted))).otherwise(F.array().cast("array<string>"))))
    return folded.select("key", kept.alias("kept"), omitted.alias("omitted"), tokens.alias("tokens"))


def stripped(text: Column, tag: str = "memory") -> Column:
    """Text without what was injected before."""
    return F.trim(F.regexp_replace(text, rf"(?s)<{tag}>.*?</{tag}>", ""))


def log_tail(log: DataFrame, n: int = 20, needle: str | None = None, day: str | None = None, action: str | None = None) -> DataFrame:
    """Last lines (line_no, line) of a log, by day, action, or a substring regardless of accents."""
    out = log
    if day:
        out = out.where(F.col("line").startswith(day))
    if action:
        out = out.where(parsed_action() == action)
    if needle:
        out = out.where(F.contains(plain(F.col("line")), plain(F.lit(needle))))
    return out.orderBy(F.desc("line_no")).limit(n)


def parsed_action() -> Column:
    return F.substring_index(F.substring("line", 21, 1_000_000), " ", 1)


def token_bill(lines: DataFrame, day: str) -> DataFrame:
    """One row: injected tokens in all and on a day, injections, tokens saved, mean."""
    rows = parse_log(lines).where("action = 'tokens'")
    n = F.regexp_extract("line", r"(\d+) tok", 1)
    of = F.regexp_extract("line", r"\(de (\d+)", 1)
    rows = rows.where(n != "").select(n.cast("long").alias("n"), F.when(of != "", of.cast("long")).alias("of"), F.col("line").startswith(day).alias("today"))
    saved = F.when(F.col("of").isNotNull(), F.greatest(F.lit(0), F.col("of") - F.col("n"))).otherwise(0)
    return rows.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("today"), F.col("n"))), F.lit(0)).alias("today"), F.count("*").alias("injections"),
        F.coalesce(F.sum(saved), F.lit(0)).alias("saved"), F.coalesce(F.bround(F.avg("n")).cast("long"), F.lit(0)).alias("mean"),
    )


def token_series(lines: DataFrame, n: int = 200) -> DataFrame:
    rows = lines.where(parsed_action() == "tokens").withColumn("tokens", F.regexp_extract("line", r"(\d+) tok", 1).cast("long"))
    return rows.where("tokens is not null").orderBy(F.desc("line_no")).limit(n).select("line_no", F.substring("line", 1, 19).alias("ts"), "tokens")


def identity(rows: DataFrame, k: int = 20) -> DataFrame:
    """Latest `k` rows (id, kind, text, created) grouped by kind, in order of writing."""
    latest = rows.orderBy(F.desc("created"), F.desc("id")).limit(k)
    return latest.groupBy("kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("created", "id", "text"))), lambda x: x["text"]).alias("texts"))


def list_view(memories: DataFrame, links: DataFrame, by: str = "created", limit: int = 100) -> DataFrame:
    """Rows without atoms, sorted as a viewer does."""
    atoms = links.where("type = 'atom'").select(F.col("dst").alias("id"))
    return memories.join(atoms, "id", "left_anti").orderBy(F.desc(by), "id").limit(limit)


def log_line(ts: Column, action: Column, detail: Column) -> Column:
    """A line of the decision log: time, action in nine columns, detail."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.rpad(action, 9, " "), F.lit(" "), detail)


def hook_context(decisions: DataFrame, hits: DataFrame, texts: DataFrame, budget: int = 350) -> DataFrame:
    """What each firing message gets injected: a header and its hits' texts by rank, fitted to the budget."""
    fires = decisions.where("action = 'recall'").select("query_id")
    shown = hits.join(fires, "query_id", "left_semi").join(texts.select("id", "text"), "id")
    lines = shown.groupBy(F.col("query_id").alias("key")).agg(F.concat(F.array(F.lit("memory:")), F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])).alias("lines"))
    return fit_budget(lines, budget)


def budget_setting(environment: str | None, stored: str | None, default: int = 350) -> int:
    """Hook budget by precedence: environment, then stored setting, then default; what is no number counts as unset."""
    for value in (environment, stored):
        try:
            return int(str(value).strip())
        except ValueError:
            continue
    return default


def budgets(environment: Column, stored: Column, default: int = 350) -> Column:
    """`budget_setting` of columns of text: the first that is a whole number, else the default."""
    number = lambda c: F.when(F.trim(c).rlike(r"^[+-]?[0-9]{1,18}$"), F.trim(c).cast("long"))
    return F.coalesce(number(environment), number(stored), F.lit(default).cast("long"))
