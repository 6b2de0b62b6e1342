"""Policies as ordered cases: the first test that holds names the decision. Each gives a Column over the named columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.folding import folded


@dataclass(frozen=True)
class Settings:
    """Defaults of every policy."""

    prune_min_chars: int = 4000
    prune_min_saving: float = 0.25
    prune_max_chars: int = 8000
    report_max: int = 3000
    report_summary: int = 1500
    report_slack: float = 1.3
    report_rest: int = 200
    retain_chars: int = 6000
    retain_whole_chars: int = 12000
    keep_result: float = 0.3
    keep_call: float = 0.5
    topic_drop: float = 0.8
    min_reduction: float = 0.25
    ask_call_chars: int = 1000
    ask_exchange_chars: int = 1500
    gate_lines: int = 100
    gate_own_text: int = 40
    gate_responses: int = 3
    gate_p: float = 0.5
    timing_min_tokens: int = 60_000
    timing_default_ttl: int = 300
    timing_grace: int = 600
    #: The cache's lifetime, if it is known better than from the history, and the idle time that always ends it.
    timing_ttl: int = 0
    timing_expired_after: float = float("inf")
    retained_fresh: int = 900

    @classmethod
    def from_env(cls, env: dict[str, str], prefix: str = "TESSERA_") -> Settings:
        """Settings with the numbers that env names; what isn't a number is left at its default."""
        got = {}
        for name, field in cls.__dataclass_fields__.items():
            try:
                got[name] = type(field.default)(env[prefix + name.upper()])
            except (KeyError, ValueError):
                continue
        return cls(**got)


DEFAULTS = Settings()


def cases(*pairs: tuple[Column, str], otherwise: str) -> Column:
    out = F
    for test, name in pairs:
        out = out.when(F.coalesce(test, F.lit(False)), name)
    return out.otherwise(otherwise)


def prune_stages(df: DataFrame, key: str, output: str = "text", command: str | None = None, budget: int | None = None, conf: Settings = DEFAULTS, failed: Column | None = None) -> DataFrame:
    """(key, stage, source_chars, visible_chars, folded, visible): how each output would be shown.

    Cheap tests come first; only outputs that pass them are folded, in Python, in one pass. Searches and listings
    aren't folded. key must be unique. A null output is small. failed: outputs whose original couldn't be written;
    what would be folded of them is archive_failed and shown whole.
    """
    said = F.coalesce(F.col(command), F.lit("")) if command else F.lit("")
    text = F.coalesce(F.col(output), F.lit(""))
    kind = T.output_class(said, text)
    early = cases((F.length(text) < conf.prune_min_chars, "small"), (T.looks_binary(text), "binary"), (kind == "document", "document"), (kind == "search", "nothing_to_fold"), otherwise="open")
    lost = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    rows = df.select(F.struct(key, early.alias("stage"), T.looks_secret(text).alias("_secret"), lost.alias("_lost"), F.length(text).cast("long").alias("source_chars")).alias("_all"), text.alias("_text"))
    rows = folded(rows, "_all", "_text", only=F.col("_all.stage") == "open").select("_all.*", "reduced", "folded")
    path = F.when(~F.col("_secret"), F.concat(F.lit("archive/"), F.col(key).cast("string")))
    room = F.col("source_chars") * (1 - conf.prune_min_saving)
    fits = F.length("shown") <= (F.least(F.lit(budget), room) if budget is not None else room)
    late = cases((F.col("folded") == 0, "nothing_to_fold"), (~fits, "not_enough_saving"), (F.col("_lost"), "archive_failed"), otherwise="fold")
    rows = rows.withColumn("shown", F.concat("reduced", T.fold_footer(F.col("folded"), path))).withColumn("stage", F.when(F.col("stage") == "open", late).otherwise(F.col("stage")))
    shows = F.col("stage") == "fold"
    return rows.select(key, "stage", "source_chars", F.when(shows, F.length("shown")).otherwise(F.col("source_chars")).cast("long").alias("visible_chars"), F.coalesce("folded", F.lit(0)).cast("long").alias("folded"), F.when(shows, F.col("shown")).alias("visible"))


def call_decision(pinned: Column, keep_result: Column, keep_call: Column, conf: Settings = DEFAULTS) -> Column:
    """action and reason of a scored call."""
    reason = cases((pinned, "pinned"), (keep_result >= conf.keep_result, "kept"), (keep_call >= conf.keep_call, "result_dropped"), otherwise="call_dropped")
    action = F.when(reason.isin("pinned", "kept"), "keep").when(reason == "result_dropped", "drop_result").otherwise("drop_call")
    return F.struct(action.alias("action"), reason.alias("reason"))


def read_gate(conf: Settings = DEFAULTS) -> Column:
    """Over enabled, agent_id, sized, lines, repeated, own_text, since, p."""
    c = F.col
    return cases(
        (~c("enabled"), "off"),
        (c("agent_id").isNotNull(), "subagent"),
        (~c("sized"), "not_a_sized_read"),
        (c("lines").isNull(), "unknown_size"),
        (c("lines") < conf.gate_lines, "below_threshold"),
        (c("repeated"), "repeated"),
        ((c("own_text") < conf.gate_own_text) & (c("since") > conf.gate_responses), "no_intent"),
        (c("p").isNull(), "no_score"),
        (c("p") >= conf.gate_p, "needed"),
        otherwise="denied",
    )


def report_guard(conf: Settings = DEFAULTS) -> Column:
    """Over report, asked: whether a report is split, passes, or is sent back once."""
    report, summary = F.col("report"), T.summary_of(F.col("report"))
    split = (F.length(summary) <= conf.report_summary * conf.report_slack) & (F.length(report) - F.length(summary) > conf.report_rest)
    return cases((split, "split"), (F.length(report) <= conf.report_max, "within_budget"), (F.col("asked"), "already_asked"), otherwise="asked")


def stop_guard(conf: Settings = DEFAULTS) -> Column:
    """Over asked, internal, handback, report: what happens when a helper stops."""
    return cases((F.col("asked"), "already_asked"), (F.col("internal"), "internal_agent"), (F.col("handback"), "handback_mode"), (F.length("report") <= conf.report_max, "within_budget"), otherwise="asked_to_shorten")


def shorten_limit(conf: Settings = DEFAULTS) -> int:
    return (conf.report_max + 1) // 2


def resume(conf: Settings = DEFAULTS) -> Column:
    """Over enabled, lost, headless, tokens, idle, expired: what to do when a session is taken up again.

    Only a session without anybody at it can be compacted at once; else its user is told. A compaction that the
    resume undid comes first. expired is what the host says of the cache; idle time alone can tell it as well.
    """
    c = F.col
    cold = F.coalesce(c("expired"), F.lit(False)) | F.coalesce(c("idle") >= F.lit(conf.timing_expired_after), F.lit(False))
    act = F.when(c("headless"), "compact").otherwise("notify")
    first = cases((~c("enabled"), "off"), (c("lost"), "act"), (c("tokens").isNull(), "no_usage"), (~cold, "cache_warm"), (c("tokens") < conf.timing_min_tokens, "below_min_tokens"), otherwise="act")
    return F.when(first == "act", act).otherwise(first)


def idle(conf: Settings = DEFAULTS) -> Column:
    """Over enabled, queued_ago, lost, compacted_since, tokens, idle, ttl, warn_only, nudged: what to do at a prompt after a pause.

    lost: a resume undid the last compaction and no prompt was stopped for it yet; compacted_since: there was another
    one since. ttl is the cache's lifetime by the history.
    """
    c = F.col
    ttl = F.lit(conf.timing_ttl) if conf.timing_ttl else F.coalesce(c("ttl"), F.lit(conf.timing_default_ttl))
    undone = c("lost") & ~F.coalesce(c("warn_only"), F.lit(False))
    return cases(
        (~c("enabled"), "off"),
        (c("queued_ago") < conf.timing_grace, "compact_queued"),
        (undone & c("compacted_since"), "compacted_since"),
        (undone, "blocked"),
        (c("tokens").isNull(), "no_usage"),
        ((c("idle") < ttl) & (c("idle") < F.lit(conf.timing_expired_after)), "cache_warm"),
        (c("tokens") < conf.timing_min_tokens, "below_min_tokens"),
        (c("warn_only"), "warned"),
        (c("nudged"), "nudged_already"),
        otherwise="blocked",
    )


_END = "(?![0-9A-Za-z_])"
#: Build, test, install and lint commands, whose output is long and repetitive.
NOISY = [
    f"(?:npm|pnpm|yarn|bun)\\s+(?:(?:run\\s+)?(?:build|test|lint|typecheck|check)(?::[0-9A-Za-z_-]+)*|install|ci|add){_END}",
    f"(?:make|gmake|ninja|pytest|jest|vitest|ctest|mvn|gradle|\\./gradlew|tsc){_END}",
    f"(?:cargo|go)\\s+(?:build|test|check|clippy|install){_END}",
    f"(?:pip3?|uv\\s+pip)\\s+install{_END}",
    f"python3?\\s+-m\\s+(?:pytest|unittest|pip\\s+install){_END}",
    f"docker\\s+(?:build|compose\\s+build){_END}",
]
#: What makes more of a command than one plain program, and settings before it.
UNSAFE = "[|;&<>`$()\\n\\r]"
ASSIGNED = "^(?:[A-Z_][A-Z0-9_]*=\\S+\\s+)*"


def wrap(command: Column, enabled: Column, runner: str = "tessera-run") -> Column:
    """Whether a command would be run through the folding runner, which approves it: only one plain noisy program is.

    Leading VAR=value settings are looked past; an empty command, and one that names the runner, isn't noisy.
    """
    said = T.trimmed(F.coalesce(command, F.lit("")))
    noisy = F.regexp_replace(said, ASSIGNED, "").rlike("^(?:" + "|".join(NOISY) + ")")
    idle_ = (said == "") | F.contains(said, F.lit(runner))
    return cases((~enabled, "off"), (idle_, "not_noisy"), (said.rlike(UNSAFE), "unsafe_shell_syntax"), (~noisy, "not_noisy"), otherwise="wrapped")


def encoded(command: Column) -> Column:
    """Base 64 in one line."""
    return F.translate(F.base64(F.encode(command, "UTF-8")), "\r\n", "")


def guidance(prompt: Column, mark: str, text: str) -> Column:
    """The prompt with a text added once, known by its mark."""
    return F.when(F.contains(prompt, F.lit(mark)), prompt).otherwise(F.concat_ws("\n\n", prompt, F.lit(f"{mark}\n{text}")))


def detail_budget(level: Column) -> Column:
    """Characters that a brief's wanted level of detail allows; null without a bound."""
    return F.when(level == "conclusion", 1200).when(level == "key_details", 3000)


#: Signs of development work: a source file's name, words of the work, the same in Korean.
WORK = [
    f"\\.(?:py|ts|tsx|js|mjs|cjs|go|rs|java|kt|rb|sh|toml|ya?ml|json|sql){_END}",
    f"(?i)(?<![0-9A-Za-z_])(?:commit|tests?|TDD|fix|implement|refactor|CI|build|lint){_END}",
    "구현|수정|테스트|커밋|리팩터|빌드",
]


def is_development(brief: Column) -> Column:
    """Two of the three signs of development work."""
    return sum((F.coalesce(brief.rlike(s), F.lit(False)).cast("int") for s in WORK), F.lit(0)) >= 2


def accepted(on_target: Column, items: Column, evidence: Column) -> Column:
    """Whether a report is sent back: scores below 0.4, 0.3, 0.3."""
    return cases((on_target < 0.4, "off_target"), (items < 0.3, "item_missing"), (evidence < 0.3, "no_evidence"), otherwise="accepted")


#: Words of a report that comes before the work is done, and of a request that it be done again.
INTERIM = "(?i)I'll (?:wait|report)|will report|waiting (?:on|for)|still (?:running|waiting)|in progress|before reporting"
CORRECTIVE = "(?i)수정|다시|고쳐|누락|빠진|빠졌|틀렸|잘못|fix|redo|missing|again|wrong|incorrect|broken|fail"


def is_interim(report: Column) -> Column:
    return (F.length(report) < 1200) & report.rlike(INTERIM)


def is_corrective(follow_up: Column) -> Column:
    return F.substring(follow_up, 1, 600).rlike(CORRECTIVE)


def in_order(facts: DataFrame, group: str, result: str, fact: str, name: str = "place") -> DataFrame:
    """facts with their place, from 1, in the conversation: by result, then by fact."""
    return facts.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(result, fact)))


def retain_choice(mode: str, rules: DataFrame, scored: DataFrame, order: list[str], carried: DataFrame | None = None) -> DataFrame:
    """off, rules, scored, hybrid: the rule facts with the scored ones that remain; rule facts are never lost. on: the
    rule facts of results that aren't carried whole, and those that are (None: the scorer failed, nothing is carried)."""
    if mode == "off":
        return rules.limit(0)
    if mode == "scored":
        return scored
    if mode == "hybrid":
        return rules.unionByName(scored.join(rules.select(*order), order, "left_anti"))
    if mode == "on" and carried is not None:
        return rules.join(carried.select(*order), order, "left_anti").unionByName(carried)
    return rules
