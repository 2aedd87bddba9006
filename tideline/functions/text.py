"""Column functions on texts: headlines, links, speech, routing and intents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the lexicon's tiers in order; a text is of the first tier of which it contains an entry
LEXICON = {
    "Highly Risky": ["closure", "close the strait", "attack", "strike", "war", "missile", "explosion", "seize", "blockade", "shut", "killed", "escalat", "invasion"],
    "Risky": ["threat", "sanction", "tension", "warning", "disrupt", "risk", "conflict", "hostil", "protest", "cut", "halt", "suspend", "premium", "spike"],
    "Safe": ["deal", "agreement", "ceasefire", "resume", "ease", "stabil", "cooperat", "truce", "reopen", "recover", "calm"],
}
NO_TIER = "Satisfactory"

# fixed values: actors and action keywords in order, each action with its name
ACTORS = [
    "Iran", "IRGC", "Houthi", "Saudi Arabia", "Aramco", "OPEC", "Russia", "Rosneft", "India", "ONGC", "IOCL", "Reliance",
    "US", "United States", "EU", "China", "Venezuela", "PDVSA", "Iraq", "Kuwait", "UAE", "ADNOC", "Qatar", "Nigeria",
]
NO_ACTOR = "unknown"
ACTIONS = {
    "sanction": "sanctions_action", "attack": "military_attack", "seize": "vessel_seizure", "block": "blockade", "cut": "production_cut", "increase": "production_increase", "export": "export_change",
    "import": "import_change", "price": "price_movement", "oil": "oil_market", "tanker": "tanker_incident", "pipeline": "pipeline_event", "refinery": "refinery_event", "ship": "shipping_event",
    "missile": "military_attack", "drone": "military_attack", "nuclear": "nuclear_event", "negotiate": "diplomacy", "treaty": "diplomacy", "embargo": "embargo",
}
NO_ACTION = "general"

# fixed values: words that send a question to the graph, as does a length of more words than LONG_QUESTION
REASONING = r"(?i)\b(why|how|compare|difference|explain|which|what would happen|trade.?off|impact|cascade|affect|relationship|between|versus|vs)\b"
LONG_QUESTION = 12

# fixed values: patterns of spoken commands
STOP = r"\b(stop|cancel|never mind|shut up|be quiet)\b"
RUN = r"\b(run|execute|simulate|kick off|start)\b.*\b(scenario|disruption|crisis|simulation)\b"
WIKI = r"\b(tell me (?:more )?about|what is|who is|open( the)? wiki(pedia)?|read( me)? about|briefing on|story on)\b"
FOCUS = r"\b(show|zoom|focus|highlight|find|go to|jump to)\b"
FIGURES = [
    (r"\bthreat( level)?\b|\brisk level\b", "threat_level"), (r"\bbrent\b|\bcrude price\b|\boil price\b", "brent_usd_bbl"), (r"\bs\.?p\.?r\.?\b|\breserve\b|\bcoverage\b", "spr_coverage_pct"),
    (r"\balerts?\b", "active_alerts"), (r"\bentit(y|ies)\b|\bnodes?\b|\bmonitor(ed|ing)?\b", "monitoring_entities"),
]
VIEWS = [
    (r"\b(command|dashboard|home|main)\b", "/command"), (r"\b(intelligence|explorer|graph|knowledge graph|map)\b", "/intelligence"), (r"\b(simulation|sandbox|lab|scenario view)\b", "/simulation"),
    (r"\b(response|procurement|reserve|planner)\b", "/response"), (r"\b(copilot|chat|assistant|ask)\b", "/copilot"),
]
VIEW_REPLIES = {"/command": "Command Center.", "/intelligence": "Global Intelligence.", "/simulation": "Simulation Lab.", "/response": "Response Planner.", "/copilot": "Strategic Copilot."}
SELECT = r"\b(select|pick|choose|show me|compare|why is)\b.*?(option \d+|option one|option two|option three|first option|second option|third option|\w+(?:\s+\w+)?)\s*(?:ranked|first|top)?\s*$"
QUESTION = r"\b(why|how|explain|compare|which|what|would|should|because|difference|tradeoff|impact|risk|scenario|cascade|between)\b"
LONG_COMMAND = 4

_BLANK = " \t\r\n\x0b\x0c"


def _first(cases: list[tuple[Column, Column | str]], otherwise: Column | str | None = None) -> Column:
    """The value of the first case that holds."""
    out = F.when(*cases[0]) if isinstance(cases[0][1], Column) else F.when(cases[0][0], F.lit(cases[0][1]))
    for hit, value in cases[1:]:
        out = out.when(hit, value if isinstance(value, Column) else F.lit(value))
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def contains_any(text: Column, words: list[str]) -> Column:
    hit = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def sentiment(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return _first([(contains_any(low, words), tier) for tier, words in LEXICON.items()], NO_TIER)


def before_stop(text: Column) -> Column:
    """What stands before the first full stop, trimmed."""
    return F.trim(F.substring_index(F.coalesce(text, F.lit("")), ".", 1), F.lit(_BLANK))


def actor(sentence: Column) -> Column:
    low = F.lower(sentence)
    return _first([(F.contains(low, F.lit(a.lower())), a) for a in ACTORS], NO_ACTOR)


def action(sentence: Column) -> Column:
    low = F.lower(sentence)
    return _first([(F.contains(low, F.lit(k)), v) for k, v in ACTIONS.items()], NO_ACTION)


def first_sentence(text: Column) -> Column:
    s = F.regexp_extract(text, r"^([^.!?\n]*[.!?])(\s|$)", 1)
    return F.when(s != "", s).otherwise(text)


def headline(text: Column) -> Column:
    """Front matter, links and white space off; the first sentence, 160 characters at most."""
    body = F.regexp_replace(text, r"^---\n[^\x00]*?\n---\n", "")
    body = F.regexp_replace(body, r"\[\[([^\]|]*)(\|[^\]]*)?\]\]", "$1")
    return F.left(first_sentence(F.trim(F.regexp_replace(body, r"[ \t\r\n]+", " "))), F.lit(160))


def links(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|]+)"), F.lit(1)))


def speakable(text: Column) -> Column:
    """Markdown for the ear: no fences, tables, lists or marks; two sentences, 320 characters at most."""
    t = F.regexp_replace(text, r"```[^`]*```", " ")
    t = F.regexp_replace(t, r"(?m)^\s*\|.*$", " ")
    t = F.regexp_replace(t, r"(?m)^\s*[-*#]+\s+", "")
    t = F.regexp_replace(t, r"\*\*|__|`|\[[0-9]+\]", "")
    t = F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))
    two = F.regexp_extract(t, r"^([^.!?]*[.!?]+ ?[^.!?]*[.!?]+)", 1)
    return F.left(F.trim(F.when(two != "", two).otherwise(t)), F.lit(320))


def strip_html(page: Column) -> Column:
    t = F.regexp_replace(page, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(t, r"[ \t\r\n\x0b\x0c]+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), " ", "_"), "/", "-")


def preset_slug(text: Column) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(40))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\r\n\x0b\x0c]+"), lambda w: w != "")


def route(text: Column) -> Column:
    return F.when(text.rlike(REASONING) | (F.size(words(text)) > LONG_QUESTION), "graph").otherwise("vector")


def spoken_entity(text: Column, names: dict[str, str]) -> Column:
    """The canonical name for an utterance, from {alias: name}: an alias that is the utterance, else the
    longest overlap by containment either way, else, of equals, the first in the list."""
    heard = F.rtrim(F.trim(F.lower(text), F.lit(_BLANK)), F.lit(".,!?"))
    rows = []
    for i, (alias, name) in enumerate(names.items()):
        low = alias.lower()
        score = F.when(heard == low, 1_000_000).when(F.contains(heard, F.lit(low)) | F.contains(F.lit(low), heard), F.least(F.length(heard), F.lit(len(low)))).otherwise(0)
        rows.append(F.struct(score.alias("s"), F.lit(-i).alias("i"), F.lit(name).alias("n")))
    best = F.array_max(F.array(*rows))
    return F.when((heard != "") & (best["s"] > 0), best["n"])


def command(text: Column, entity: Column) -> Column:
    """A struct (type, target, said, is_query) for an utterance and the entity it names, by rules in order."""
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(_BLANK))
    low, named = F.lower(t), entity.isNotNull()
    last = F.element_at(F.concat(F.array(F.lit("")), words(t)), -1)
    chosen = F.coalesce(entity, last)

    def act(kind: str | None, target: Column | str | None = None, said: Column | None = None, query: Column | bool = False) -> Column:
        text_of = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(F.lit(kind).cast("string").alias("type"), text_of(target).cast("string").alias("target"), (said if said is not None else F.lit(None)).cast("string").alias("said"), text_of(query).alias("is_query"))

    rules = [
        ((t == "") | low.rlike(STOP), act(None)),
        (low.rlike(RUN) & named, act("run_scenario", entity, F.concat(F.lit("Running the "), entity, F.lit(" scenario.")))),
        (low.rlike(WIKI) & named, act("open_wiki", entity, query=True)),
        (low.rlike(FOCUS) & named, act("focus_entity", entity, F.concat(F.lit("Here's "), entity, F.lit(".")))),
        *((low.rlike(p), act("flash_kpi", key)) for p, key in FIGURES),
        *((low.rlike(p), act("navigate", path, F.lit(VIEW_REPLIES[path]))) for p, path in VIEWS),
        (low.rlike(SELECT), act("select_option", chosen, F.concat(F.lit("Selecting "), chosen, F.lit(".")))),
    ]
    return _first(rules, act(None, query=low.rlike(QUESTION) | (F.size(words(t)) > LONG_COMMAND)))


def json_part(text: Column) -> Column:
    """From the first opening to the last closing brace; null without both."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
