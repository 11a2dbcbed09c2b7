"""Investigations of many cases at once, as a table of states that moves in rounds.

In each round every open case makes one call, whatever its state: it asks what to look at next, or for an answer. The
replies are checked and each case moves on by the same columns as a single one would. Texts stay out of the states; a
round joins the evidence that it needs, packed to the case's budget of the moment. Lineage is cut each round; a case makes
at most CALLS + TOOLS calls, so there are no more rounds than that, however many cases there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators import answers
from faultline.operators.history import cut

# Calls for an answer and for tools, budgets of evidence, the tools.
CALLS, TOOLS = 3, 3
BUDGET, EXPANDED, SHRUNK = 24_000, 40_000, 12_000
TOOL_NAMES = ("read_file", "search_code", "list_files")

PROPOSAL = "struct<failure_type:string,root_cause:string,confidence:double,files:array<string>,quotes:array<string>>"
REQUEST = "struct<name:string,path:string,pattern:string,start_line:int>"
#: What a client answers a request (key, kind, turn) with: kind is decide or answer, turn counts the requests of that kind.
REPLY = f"error string, error_kind string, action {REQUEST}, proposal {PROPOSAL}"
#: What the model is told when its output was cut off or wasn't JSON.
CUT_OFF = "the last answer was no complete JSON object: use short quotes of single lines and send the whole object"

Client = Callable[[DataFrame], DataFrame]


def scripted(replies: DataFrame, key: str) -> Client:
    """A client that answers from a table: key, kind, turn and the fields of REPLY; a request that it lacks fails."""

    def ask(requests: DataFrame) -> DataFrame:
        found = requests.join(replies.withColumn("known", F.lit(True)), [key, "kind", "turn"], "left")
        missing = F.col("known").isNull()
        return found.withColumn("error_kind", F.when(missing, "transport").otherwise(F.col("error_kind"))).withColumn("error", F.when(missing, "no reply").otherwise(F.col("error"))).drop("known")

    return ask


def no_tools(requests: DataFrame) -> DataFrame:
    """Refuses every request."""
    return requests.withColumn("result", F.lit("no such tool"))


def _start(cases: DataFrame, key: str, tools: bool) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    return cases.select(
        key,
        F.lit("decide" if tools else "propose").alias("node"),
        F.lit(BUDGET).alias("budget"),
        F.lit(False).alias("shrunk"),
        F.lit(0).alias("decide_calls"),
        F.lit(0).alias("answer_calls"),
        F.array().cast(f"array<{REQUEST}>").alias("requests"),
        F.array().cast("array<string>").alias("results"),
        F.lit("").alias("error_kind"),
        none(PROPOSAL).alias("proposal"),
        F.lit("").alias("problems"),
    )


def _gather(asked: DataFrame, tool: Client, key: str) -> DataFrame:
    """States after their decide call: a tool was run, or an answer is asked for next."""
    name = F.col("action.name")
    acts = (F.col("replied_kind") == "") & F.coalesce(name.isin(*TOOL_NAMES), F.lit(False))
    request = F.struct(name.alias("name"), F.nullif("action.path", F.lit("")).alias("path"), F.nullif("action.pattern", F.lit("")).alias("pattern"), F.col("action.start_line").alias("start_line"))
    asked = asked.withColumns({"acts": acts, "request": request})
    told = asked.withColumn("error_kind", F.col("replied_kind"))
    stays = told.where("not acts").withColumns({"node": F.lit("propose"), "result": F.lit(None).cast("string")})
    acted = tool(told.where("acts"))
    stuck = F.exists("requests", lambda r: r.eqNullSafe(F.col("request")))
    acted = acted.withColumn("node", F.when(~stuck & (F.size("requests") + 1 < TOOLS), "decide").otherwise("propose"))
    acted = acted.withColumns({"requests": F.array_append("requests", F.col("request")), "results": F.array_append("results", F.coalesce("result", F.lit("")))})
    return stays.drop("result").unionByName(acted.drop("result"))


def _settle(asked: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """States after a call for an answer: checked, and routed on."""
    answered = F.col("replied_kind") == ""
    now = asked.withColumns({"error_kind": F.col("replied_kind"), "before": F.col("problems"), "proposal": F.when(answered, F.col("replied")).otherwise(F.col("proposal"))}).drop("problems")
    packed = answers.budget_fold(now.join(cases.select(key, "sections", "known"), key), "budget").drop("sections", "cut")
    evidence = F.concat_ws("\n\n", "packed", F.when(F.size("results") > 0, F.array_join(F.transform("results", lambda r: F.concat(F.lit("## result\n"), r)), "\n\n")))
    checked = answers.problems(packed.withColumns({"evidence": evidence, "failure_type": F.col("proposal.failure_type"), "root_cause": F.col("proposal.root_cause"), "quotes": F.col("proposal.quotes"), "files": F.col("proposal.files")}))
    failed = F.when(F.col("error_kind") == "output", CUT_OFF).otherwise(F.coalesce(F.nullif("error", F.lit("")), F.lit("no answer")))
    checked = checked.withColumn("problems", F.when(F.col("error_kind") != "", failed).otherwise(F.col("problems")))
    flags = checked.select(
        key, "budget", F.col("shrunk"), "decide_calls", "answer_calls", "requests", "results", "error_kind", F.col("proposal").alias("held"), F.col("problems").alias("told"),
        F.col("proposal").isNotNull().alias("proposal"),
        F.coalesce(F.col("failure_type") == "UNKNOWN", F.lit(False)).alias("unknown"),
        (F.col("problems") != "").alias("problems"),
        (F.col("problems") == F.col("before")).alias("repeated"),
        (F.col("answer_calls") < CALLS).alias("calls_left"),
        (F.col("budget") < EXPANDED).alias("small"),
    )
    routed = answers.route(flags)
    to = F.col("next")
    return routed.select(
        key,
        F.when(to.isin("expand", "shrink"), "propose").otherwise(to).alias("node"),
        F.when(to == "expand", EXPANDED).when(to == "shrink", SHRUNK).otherwise(F.col("budget")).alias("budget"),
        (F.col("shrunk") | (to == "shrink")).alias("shrunk"),
        "decide_calls", "answer_calls", "requests", "results",
        F.when(to == "shrink", "").otherwise(F.col("error_kind")).alias("error_kind"),
        F.col("held").alias("proposal"),
        F.col("told").alias("problems"),
    )


def investigate(cases: DataFrame, ask: Client, key: str, tool: Client | None = None) -> DataFrame:
    """The last state of each case: node (finalize or end), calls, requests and results of tools, proposal, problems, budget.

    cases: key, sections (array of name, body, share) and known (paths). ask: gets requests (key, kind, turn, and the
    state), returns them with the fields of REPLY. tool: gets requests (request), returns them with result; without one
    no case asks for tools. A case that ends without a proposal has none.
    """
    cases = cases.select(key, "sections", "known")
    states = cut(_start(cases, key, tool is not None))
    while not (open_ := states.where("node not in ('finalize', 'end')")).isEmpty():
        decides = F.col("node") == "decide"
        counted = open_.withColumns({"decide_calls": F.col("decide_calls") + decides.cast("int"), "answer_calls": F.col("answer_calls") + (~decides).cast("int")})
        requests = counted.withColumns({"kind": F.when(decides, "decide").otherwise("answer"), "turn": F.when(decides, F.col("decide_calls")).otherwise(F.col("answer_calls"))})
        renamed = {"error_kind": "state_error", "proposal": "state_proposal"}
        replies = ask(requests.withColumnsRenamed(renamed)).withColumns({"replied_kind": F.coalesce("error_kind", F.lit("")), "replied": F.col("proposal")}).drop(*renamed)
        replies = cut(replies.withColumnsRenamed({v: k for k, v in renamed.items()}))
        settled = _settle(replies.where("kind = 'answer'"), cases, key)
        if tool is not None:
            gathered = _gather(replies.where("kind = 'decide'"), tool, key)
            settled = settled.unionByName(gathered.select(*settled.columns))
        states = cut(states.where("node in ('finalize', 'end')").unionByName(settled))
    return states
