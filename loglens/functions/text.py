"""Text measures and classifiers as Column expressions. Whole-stage code, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the next message says about the last one. Case-insensitive.
PRAISE = r"\b(perfect|awesome|amazing|fantastic|excellent|beautiful|brilliant|love (it|this)|great( work| job)?|nice( work)?|nailed it|exactly( right)?|works( now| great)?|that works|this works|thanks|thank you|thx|🎉|so good|wonderful)\b"
PROCEED = r"^(ok(ay)?|cool|yes|yep|yeah|sure|sounds good|got it|lgtm|good|alright|great)\b|^(let'?s|lets) (build|do|go|implement|ship|make|fix|continue with|try|move)|\bgo ahead\b|\b(commit|push|merge|open a pr|ship it)\b"
CORRECT = r"^(no|nope|nah|wrong|stop|wait|hmm+|ugh)\b|that'?s not|not what i|why (didn'?t|did|would|are) you|you didn'?t|still (doesn'?t|isn'?t|not|broken|failing|seeing|getting)|(didn'?t|doesn'?t|won'?t|isn'?t) work|\bbroke(n)?\b|\bregressed\b|\b(this is|you introduced) a regression\b|\bthe whole point\b|\bas i said\b|\bi said\b|\bagain[,:]|\bnot the point\b|\bundo\b|\brevert\b|\bthat was(n'?t)?\b.*\bwrong\b|confus"
INFRA = r"\b(rate[- ]?limit(ed)?|hit (its|the|my) limit|reconnect|re-?auth|resume|are you there|hello\?|say hello|timed? ?out|expired|capacity|lost connection|disconnected)\b|^(continue|please continue|keep going|done|done!|signed in|i'?m in)\b\.?$|^(whoops|oops)"
CAPS_RUN = r"\b[A-Z]{2,}(?:\s+[A-Z]{2,}){2,}\b"  # case-sensitive
REMINDER = (r"^\W*(ok\W+)?again\b", r"\b(as i said|like i said|remember|reminder|again, (no|let'?s|think|make))\b")
CHECKIN = r"(\bright\?|^(is|are|will|does|did|do|can|should)\b[^.]*\?)\s*$"
PLEASE, THANKS, OK_OPEN = r"\bplease\b", r"\b(thanks|thank you|thx)\b", r"^(ok|okay)\b"

# What a prompt holds, in this order. (name, pattern, flags besides i)
FEATURE_PATTERNS = [
    ("gives_context", r"(`[^`]+`|/[\w.-]+/[\w.-]+|https?://|\berror\b|\btraceback\b|\bline \d+|\.(py|ts|tsx|js|md|json|go|rs)\b)", ""),
    ("explains_why", r"\b(because|so that|the goal|the point|ideally|i want|i'd like|we need|in order to|the issue|the problem|so we)\b", ""),
    ("defines_done", r"\b(make sure|confirm|verify|test(s|ed)?\b|until|should (be|return|show|work)|deliverable|success|pass(es|ing)?\b|check that|acceptance)\b", ""),
    ("sets_constraints", r"\b(don'?t|do not|without|only|must|never|avoid|no more than|keep it)\b", ""),
    ("plan_first", r"(no code|don'?t (write|execute|build|implement)|without writing|plan (it|this|out)?|just (product )?thinking|before (we|you) (build|write|code)|what would it (take|entail))", ""),
    ("gives_example", r"\b(e\.g\.|for example|for instance|such as|something like|along the lines of|like this)\b", ""),
    ("numbered_steps", r"(^|\s)(1[.)]|1\)|step 1|first,).*(2[.)]|2\)|then|second)", "s"),
    ("one_at_a_time", r"\b(one at a time|one by one|in (small )?(batches|tranches)|incremental|step by step|piece by piece)\b", ""),
    ("delegates_parallel", r"\b(fan out|in parallel|subagents?|spin up|several agents|an agent to)\b", ""),
    ("pastes_evidence", r"(error|exception|failed|status \d{3}|\bat [\w.]+ \(|^\s{2,}\S)", "m"),
]
EVIDENCE_LENGTH, TERSE_WORDS, LONG_WORDS, INFRA_WORDS, CHECKIN_WORDS = 400, 5, 120, 14, 15
FEATURES = [name for name, *_ in FEATURE_PATTERNS] + ["terse", "long_brief"]
REACTIONS = ["praise", "proceed", "correct", "retry", "infra", "end", "new-ask", "unknown"]
JUDGED, GOOD = ["praise", "proceed", "correct"], ["praise", "proceed"]


def matches(text: Column, pattern: str, flags: str = "i") -> Column:
    """Whether pattern is found; Unicode classes and only \\n as a line end, as in Python's re."""
    return F.rlike(text, F.lit(f"(?dU{flags}){pattern}"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def norm_spaces(text: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.regexp_replace(strip(F.lower(text)), r"(?U)\s+", " ")


def norm_words(text: Column) -> Column:
    """Lower case, everything but word characters collapsed to one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+", " "))


def caps_run(text: Column) -> Column:
    return matches(text, CAPS_RUN, "")


def reaction(text: Column) -> Column:
    """praise, proceed, correct, infra, new-ask or unknown (NULL or blank)."""
    t = strip(F.coalesce(text, F.lit("")))
    return (
        F.when(t == "", "unknown")
        .when(matches(t, INFRA) & (word_count(t) <= INFRA_WORDS), "infra")
        .when(matches(F.substring(t, 1, 160), CORRECT) | caps_run(t), "correct")
        .when(matches(F.substring(t, 1, 120), PRAISE) | F.startswith(t, F.lit("🎉")), "praise")
        .when(matches(F.substring(t, 1, 80), PROCEED), "proceed")
        .otherwise("new-ask")
    )


def feature(text: Column, name: str) -> Column:
    if name == "terse":
        return word_count(text) <= TERSE_WORDS
    if name == "long_brief":
        return word_count(text) >= LONG_WORDS
    pattern, flags = next((p, f) for n, p, f in FEATURE_PATTERNS if n == name)
    found = matches(text, pattern, "i" + flags)
    return (F.length(text) > EVIDENCE_LENGTH) & found if name == "pastes_evidence" else found


def features(text: Column) -> Column:
    """The names of the features that text has, in their fixed order."""
    return F.filter(F.array(*[F.when(feature(text, n), F.lit(n)) for n in FEATURES]), lambda x: x.isNotNull())


def is_reminder(text: Column) -> Column:
    return matches(text, REMINDER[0]) | matches(text, REMINDER[1])


def is_checkin(text: Column) -> Column:
    return (word_count(text) <= CHECKIN_WORDS) & matches(strip(text), CHECKIN)


def seconds_text(ts: Column) -> Column:
    """Epoch seconds as Python prints a float, for up to six decimals."""
    return F.regexp_replace(ts.cast("decimal(20,6)").cast("string"), r"(\.\d+?)0*$", "$1")


def prompt_id(agent: Column, session: Column, ts: Column, text: Column) -> Column:
    joined = F.concat_ws(chr(0), agent, session, seconds_text(ts), text)
    return F.concat(F.lit("p_"), F.substring(F.sha2(joined, 256), 1, 20))


# Tags that tools inject into messages.
INJECTED_TAG = r"<(system-reminder|command-[a-z-]+|local-command-[a-z-]+|task-notification|ide_[a-z_]+|pasted_content[^>]*)>.*?</\1[^>]*>"


def without_injected(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"(?s){INJECTED_TAG}", ""))


def half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)
