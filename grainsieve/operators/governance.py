"""Detection and removal of what readers of a knowledge base shouldn't see.

Detectors are rows of a table: a regular expression, a tag and how much text counts as evidence. All
of them run in one pass over the chunks, without a shuffle; findings of a chunk are an array until
they are exploded. Cleaning works on that array, so that chunks aren't joined with their findings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainsieve.functions import text as T
from grainsieve.functions.rows import elements, structs


@dataclass(frozen=True)
class Detector:
    """``where`` is a condition on the match ``m``; ``about`` a prefix of the reason; ``sentence`` evidence or the match itself; one finding per sentence if ``once``."""

    name: str
    tag: str
    pattern: str
    about: str
    sentence: bool = True
    once: bool = False
    where: str = "true"
    group: int = 0


#: Tag, what is done with it by default, its precedence and the caveat served with it.
TAGS = (
    ("content", "answer", 99, ""),
    ("pii", "block", 1, ""),
    ("internal_only", "block", 2, ""),
    ("metadata_leak", "block", 3, ""),
    ("editorial", "block", 4, ""),
    ("placeholder", "block", 5, ""),
    ("destructive", "review", 6, "Describes an action that destroys something; check what it applies to and what it needs first."),
    ("vague_claim", "review", 7, "Worded vaguely, without specific guidance; ask support for details."),
    ("broken_reference", "review", 8, "Refers to something that isn't in the knowledge base or may be outdated."),
    ("escalation", "review", 9, "Describes an escalation without contact details; ask your team for the right path."),
    ("stale", "review", 99, "May be outdated, given when its source was last updated; check a current one."),
    ("custom_block", "block", 99, ""),
    ("custom_review", "review", 99, ""),
)
BLOCK_PRIORITY = 5
FUNCTIONAL_MAILBOXES = sorted("team support security sales privacy office noreply legal info hr hello help feedback dpo contact compliance billing admin".split())

_URL = r"https?://"
_ROLE = T.any_of("Lead", "Edited by", "Customer", "Contact", "Client", "Author", "Assigned to")
_NAME = "[A-Z][a-z]{2,} [A-Z][a-z]{2,}"
_DONE = T.any_of("updated", "determined", "defined", "completed", "added")
_ALL = T.any_of("all", "most")


def _near(words: str) -> str:
    """Whether the text around a match, 80 characters before and 30 after, has one of the words."""
    return f"concat(right(lower(m.before), 80), lower(m.match), left(lower(m.after), 30)) rlike {T.quote(T.any_of(*words.split(';')))}"


_PUBLISHED = _near("support;reach us;helpdesk;contact us;call us")
_BANK = _near("transaction;swift;routing;reference;invoice;iban;bank;account")
_TICKET = _near("ticket;jira;issue;case")
_PHONE = r"(?:\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}(?:\s*(?:x|ext)\.?\s*\d+)?"


def detectors(pii_mode: str = "smart", mailboxes: list[str] = FUNCTIONAL_MAILBOXES, off: tuple[str, ...] = ()) -> list[Detector]:
    """The table of detectors, in order. ``off`` names tags that aren't looked for."""
    if pii_mode not in ("strict", "smart", "lenient"):
        raise ValueError(f"unknown pii_mode {pii_mode!r}")
    smart = pii_mode == "smart"
    person = "not exists(split(lower(regexp_extract(m.match, {0}, 0)), ' '), w -> array_contains({1}, w))".format(
        T.quote(_NAME + r"\z"), T.array_of(sorted("your the their team support sales relevant our on manager management issuer finance card billing appropriate account".split()))
    )
    out = [Detector("internal_note", "internal_only", "(?i)" + T.any_of(
        "internal knowledge base", r"INTERNAL\s*(?:USE|ONLY|NOTE)", "for internal use only", r"do not share(?:\s+with\s+customers)?", "confidential",
        r"agents?\s+(?:should|only)", "not for (?:public|external|customer)"), "Internal marker found")]
    if pii_mode != "lenient":
        known = f"not array_contains({T.array_of(sorted(mailboxes))}, lower(split_part(m.match, '@', 1)))"
        out += [
            Detector("pii_email", "pii", r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", "Personal email address", sentence=False, where=known if smart else "true"),
            Detector("pii_phone", "pii", _PHONE, "Phone number", where=f"not ({_PUBLISHED}) and not ({_BANK}) and not ({_TICKET})" if smart else "true"),
        ]
        if smart:
            out.append(Detector("pii_financial", "pii", _PHONE, "Financial account number", where=f"not ({_PUBLISHED}) and ({_BANK})"))
        out.append(Detector("pii_financial", "pii", r"(?i)(?:swift|routing|iban|account)[\s:]+\d{6,}", "Financial account number"))
    out += [
        Detector("pii_name", "pii", _ROLE + r"[\s:]+" + _NAME, "Person name", where=person),
        Detector("pii_name_email", "pii", _NAME + r"\s*\([a-zA-Z0-9._%+-]+@", "Person name with email"),
        Detector("placeholder", "placeholder", "(?i)" + T.any_of(
            r"\[insert .+?\]", f"to be {_DONE}", "placeholder", "coming soon", "add (?:section|information|details|content) (?:here|for|about)",
            T.any_of("XXX", "TODO", "TBD", "HACK", "FIXME") + r"\b"), "Placeholder found", once=True),
        Detector("editorial_tracked_change", "editorial", r"(?i)\[TRACKED CHANGE.*?\]", "Tracked change", sentence=False),
        Detector("editorial_html_comment", "editorial", r"(?s)<!--.*?-->", "Hidden comment", sentence=False),
        Detector("editorial_draft_marker", "editorial", r"(?i)pending\s+(?:approval|(?:legal\s+)?review)|DRAFT\s+v?\d", "Draft marker", sentence=False),
        Detector("editorial_revision_note", "editorial", r"(?i)" + T.any_of("previous version", "last edited", "edited by") + r"\s+(?:by\s+)?[A-Z][a-z]+", "Revision note", sentence=False),
        Detector("editorial_strikethrough", "editorial", r"~~.+?~~", "Struck out text", sentence=False),
        Detector("metadata_jira_id", "metadata_leak", r"(?i)\b" + T.any_of("TICKET", "JIRA", "ISSUE") + r"[\s-]?\d{3,}", "Ticket number", sentence=False),
        Detector("metadata_internal_url", "metadata_leak", _URL + r"(?:[\w-]+\.)?internal\.[\w.-]+[/\w.-]*", "Internal address", sentence=False),
        Detector("metadata_admin_url", "metadata_leak", _URL + T.any_of("staging", "dev", "debug", "admin") + r"\.[\w.-]+[/\w.-]*", "Address for administrators", sentence=False),
        Detector("metadata_debug_url", "metadata_leak", _URL + r"[\w.-]+/[/\w]*\?.*" + T.any_of("mode=", "verbose", "debug") + r"\w*", "Address with debug parameters", sentence=False),
        Detector("metadata_slack_channel", "metadata_leak", r"(?i)#[a-z][\w-]*(?:-\d{4}-\d{2}(?:-\d{2})?)?", "Channel", sentence=False),
        Detector("metadata_build_number", "metadata_leak", r"(?i)(?:release|deploy|build)\s+[\w.-]+-(?:rc|alpha|beta)\d*", "Build", sentence=False),
        Detector("metadata_sprint_ref", "metadata_leak", r"(?i)Sprint\s+\d+", "Sprint", sentence=False),
        Detector("metadata_vpn_resource", "metadata_leak", r"(?i)VPN\s+required", "Resource behind a VPN", sentence=False),
        Detector("vague_claim", "vague_claim", "(?i)" + T.any_of(
            f"works? {T.any_of('without issue', 'out of the box', 'automatically')}", f"will be {T.any_of('resolved', 'handled', 'addressed')} accordingly",
            "takes? care of everything", "take appropriate action", f"seamlessly {T.any_of('manages', 'integrates', 'handles')}",
            f"handles? {_ALL} (?:edge )?cases", "automatically handles",
            f"{_ALL} {T.any_of('situations', 'scenarios', 'cases')} (?:will be |are )?{T.any_of('supported', 'handled', 'covered')}"), "Vague claim", once=True),
        Detector("destructive", "destructive", "(?i)" + T.any_of(
            "wipe", "reset all", "remove permanently", "purge", "format disk", "factory reset", "erase all", "drop table", "destroy", "delete", "deactivate account"), "Destructive action"),
        Detector("broken_reference", "broken_reference", "(?i)" + T.any_of(
            r"\[(?:image|figure|diagram) .+?- (?:image )?not available\]", r"refer to (?:our |the )?\w+", "link (?:unavailable|not found|broken)", "image not available",
            "see (?:the |our )?" + T.any_of("wiki", "page", "handbook", "guide", "documentation", "FAQ") + r"\b"), "Broken reference",
            where="not m.match rlike '(?i)^refer to (?:Table|Figure)'"),
        Detector("escalation_no_details", "escalation", "(?i)" + T.any_of(
            r"contact (?:the team|them|support)\b", "escalate to (?:the )?(?:appropriate )?" + T.any_of("team", "supervisor", "management")), "Escalation without contact details",
            where="not (m.match rlike '(?i)^contact' and m.after rlike '^ (?:via|by|at)') and not left(m.after, 100) rlike '(?i)@|#[a-z0-9_]|slack|phone|ext[.]|email'"),
    ]
    return [d for d in out if d.tag not in off]


#: Lower-case words one of which any match of a detector holds: looked for first, as plain search is much faster than a regular expression.
HINTS = {
    "internal_note": "internal;do not share;confidential;agent;not for ", "pii_email": "@", "pii_name": "lead;edited by;customer;contact;client;author;assigned to", "pii_name_email": "@",
    "placeholder": "[insert ;to be ;placeholder;coming soon;add ;xxx;todo;tbd;hack;fixme", "editorial_tracked_change": "[tracked change", "editorial_html_comment": "<!--", "editorial_draft_marker": "pending;draft",
    "editorial_revision_note": "previous version;last edited;edited by", "editorial_strikethrough": "~~", "metadata_jira_id": "ticket;jira;issue", "metadata_internal_url": "://", "metadata_admin_url": "://", "metadata_debug_url": "://",
    "metadata_slack_channel": "#", "metadata_build_number": "release;deploy;build", "metadata_sprint_ref": "sprint", "metadata_vpn_resource": "vpn", "vague_claim": "work;accordingly;care of everything;appropriate action;seamlessly;cases;handles;situations;scenarios",
    "destructive": "wipe;reset all;remove permanently;purge;format disk;factory reset;erase all;drop table;destroy;delete;deactivate account", "broken_reference": "not available;refer to ;link ;see ", "escalation_no_details": "contact ;escalate to ",
}
#: What a match begins with: one look at most characters instead of one for each phrase; results are the same.
_FIRST = {"internal_note": "(?=[IiFfDdCcAaNn])", "placeholder": "(?=[TtPpCcAaXxHhFf]|\\[)", "vague_claim": "(?=[WwTtSsHhAaMmEe])", "broken_reference": "(?=[RrLlIiSs]|\\[)"}
_FOUND = "array<struct<detector:string,tag:string,evidence:string,matched:string,reason:string,ord:bigint>>"


def _findings(d: Detector, order: int, content: str) -> str:
    said = T.evidence("m") if d.sentence else "left(m.match, 100)"
    if d.name == "pii_email":
        said = "m.match"
    pattern = "(?=[+(0-9])" + d.pattern if d.pattern == _PHONE else _FIRST.get(d.name, "") + d.pattern
    rows = f"transform(filter({T.matches(content, pattern)}, m -> {d.where}), m -> named_struct('detector', '{d.name}', 'tag', '{d.tag}', 'evidence', {said}, 'matched', m.match, 'reason', concat('{d.about}: \"', left(m.match, 60), '\"'), 'ord', {order} * 4294967296L + m.ord))"
    if d.once:
        rows = T.first_of_each(rows, "lower(left(x.evidence, 80))")
    if d.name not in HINTS:
        return rows
    hint = " OR ".join(f"contains(low, {T.quote(h)})" for h in HINTS[d.name].split(";"))
    return f"IF({hint}, {rows}, CAST(array() AS {_FOUND}))"


def with_findings(chunks: DataFrame, table: list[Detector] | None = None, *, content_col: str = "content", into: str = "findings") -> DataFrame:
    """``chunks`` with an array of findings: detector, tag, evidence, matched, reason, ord."""
    parts = [_findings(d, k, content_col) for k, d in enumerate(table or detectors())]
    return chunks.withColumn(into, F.expr(f"IF({content_col} IS NULL, NULL, transform(array(lower({content_col})), low -> concat({', '.join(parts)}))[0])"))


def findings(chunks: DataFrame, table: list[Detector] | None = None, *, id_cols: tuple[str, ...] = ("doc_id",), content_col: str = "content") -> DataFrame:
    """One row for each finding, with the chunk's key."""
    found = with_findings(chunks.select(*id_cols, content_col), table, content_col=content_col, into="_f")
    return structs(found, id_cols, "_f", "detector")


def destructive_in_domain(chunks: DataFrame, phrases: DataFrame, *, id_cols: tuple[str, ...] = ("doc_id",), content_col: str = "content") -> DataFrame:
    """First match of each destructive phrase of the corpus (column ``phrase``); phrases are two words, so chunks are matched by an equi join on word pairs."""
    pairs = elements(chunks, (*id_cols, content_col), f"array_distinct(transform(array({T.pieces(f'lower({content_col})', T.NOT_WORD)}), w -> transform(sequence(1, greatest(1, size(w) - 1)), i -> concat(w[i - 1], ' ', coalesce(get(w, i), ''))))[0])", "phrase")
    safe = [f"{verb} refund" for verb in ("request", "request a", "get a")]
    hit = pairs.join(phrases.select("phrase").where(~F.col("phrase").isin(safe)).distinct(), "phrase")
    # two words next to each other may have more than a blank between them
    at = f"regexp_instr(lower({content_col}), concat('\\\\b', phrase, '\\\\b'))"
    m = f"IF({at} > 0, named_struct('match', substr({content_col}, {at}, length(phrase)), 'p', {at}), NULL)"
    told = hit.withColumn("m", F.expr(m)).where("m is not null")
    told = told.withColumn("m", F.expr(f"named_struct('match', m.match, 'before', left({content_col}, m.p - 1), 'after', substr({content_col}, m.p + length(m.match)))"))
    return told.select(*id_cols, F.lit("destructive_domain").alias("detector"), F.lit("destructive").alias("tag"), F.expr(T.evidence("m")).alias("evidence"), "phrase")


def with_more(chunks: DataFrame, found: DataFrame, *, key: str = "chunk") -> DataFrame:
    """``chunks`` with the findings of ``destructive_in_domain`` behind their own, so that they tag a chunk as those do."""
    reason = F.concat(F.lit('Destructive action: "'), F.col("phrase"), F.lit('"'))
    row = F.struct("detector", "tag", "evidence", F.col("phrase").alias("matched"), reason.alias("reason"), F.lit(1 << 41).cast("long").alias("ord"))
    more = found.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("_more"))
    out = chunks.join(more, key, "left").withColumn("findings", F.expr("IF(_more IS NULL, findings, concat(findings, _more))"))
    return out.select(*chunks.columns)


def tag_table(spark) -> DataFrame:
    return spark.createDataFrame(list(TAGS), "tag string, behavior string, priority int, caveat string")


def priority_of(tag: str) -> str:
    return "CASE " + " ".join(f"WHEN {tag} = '{t}' THEN {p}" for t, _, p, _ in TAGS) + " ELSE 99 END"


def behavior(chunks: DataFrame, overrides: dict[str, str] | None = None, *, tag_col: str = "tag") -> DataFrame:
    """What is done with each chunk: answer, block, review or what ``overrides`` says of its tag; and its caveat."""
    said = {t: b for t, b, _, _ in TAGS} | (overrides or {})
    lookup = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return chunks.withColumn("behavior", F.coalesce(F.try_element_at(lookup(said), F.col(tag_col)), F.lit("review"))).withColumn(
        "caveat", F.coalesce(F.try_element_at(lookup({t: c for t, _, _, c in TAGS}), F.col(tag_col)), F.lit(""))
    )


_WIPE = "upper(f.evidence) rlike 'NOT FOR PUBLICATION|INTERNAL NOTE|FOR INTERNAL USE ONLY|DO NOT SHARE|CONFIDENTIAL'"
#: Detector and what is cut out where it found something.
INLINE = (
    ("editorial_tracked_change", r"\[TRACKED CHANGE[^\]]*\]\.?\s*"),
    ("editorial_html_comment", r"(?s)<!--.*?-->\s*"),
    ("editorial_draft_marker", r"(?i)DRAFT\s+v?\d[^.]*\.?\s*"),
    ("editorial_revision_note", r"(?i)(?:Previous version|Last edited|Edited)\s+by\s+[^.]*\.?\s*"),
    ("editorial_strikethrough", r"~~[^~]+~~\.?\s*"),
    ("metadata_internal_url metadata_admin_url metadata_debug_url", _URL + r"(?:[\w-]+\.)?" + T.any_of("staging", "internal", "debug", "admin") + r"\.[\w./-]*\s*"),
    ("metadata_slack_channel", r"(?i)#[a-z][\w-]*(?:-\d{4}-\d{2}(?:-\d{2})?)?\s*"),
    ("metadata_vpn_resource", r"(?i)\(VPN\s+required\)\s*"),
)
LEAST_WORDS = 10


def without_sentences(content: str, found: str) -> str:
    """Sentences that hold no evidence of the findings."""
    keys = f"array_distinct(flatten(transform({found}, f -> array(lower(left(f.evidence, 50)), lower(left(f.matched, 60))))))"
    holds = T.bound("lower(s)", "l", "exists(k, e -> contains(l, e) OR contains(e, left(l, 50)))")
    keep = f"filter({T.sentences(content, False)}, s -> NOT {holds})"
    return f"transform(array(array_remove({keys}, '')), k -> array_join({keep}, ' '))[0]"


def without_patterns(content: str, found: str) -> str:
    """Text without what the inline detectors of the findings mark."""
    for names, pattern in INLINE:
        some = " OR ".join(f"f.detector = '{n}'" for n in names.split())
        content = f"transform(array({content}), c -> IF(exists({found}, f -> {some}), {T.replace('c', pattern, '')}, c))[0]"
    return content


def clean(chunks: DataFrame, *, content_col: str = "content", found: str = "findings") -> DataFrame:
    """Chunks without blocked content, from an array of findings.

    New columns: ``words_before``, ``words``, ``tag``, ``tag_reason``, ``changed``. Blocked sentences and patterns go, a
    chunk marked internal goes as a whole, as does what is left with under ten words. White space alone
    isn't a change. A chunk with findings for review only gets the tag of the first in precedence.
    """
    prio = lambda f: priority_of(f"{f}.tag")
    out = chunks.withColumn("_found", F.coalesce(F.col(found), F.expr(f"filter({found}, x -> false)")))
    out = out.withColumn("_block", F.expr(f"filter(_found, f -> {prio('f')} <= {BLOCK_PRIORITY})"))
    cut = without_patterns(without_sentences(content_col, "_block"), "_block")
    wiped = f"exists(_block, f -> f.tag = 'internal_only' AND {_WIPE})"
    out = out.withColumn("_new", F.expr(f"IF(size(_block) = 0, {content_col}, IF({wiped}, '', {cut}))"))
    out = out.withColumn("_new", F.expr(f"IF(size(_block) = 0, _new, {T.replace('trim(' + T.replace('_new', T.SPACE + '{2,}', ' ') + ')', r'\.\s*\.', '.')})"))
    out = out.withColumn("words_before", F.expr(T.word_count(content_col)))
    out = out.withColumn("changed", F.expr(f"size(_block) > 0 AND {T.squeeze('_new')} <> {T.squeeze(content_col)}"))
    out = out.withColumn("_new", F.expr(f"IF(changed, IF({T.word_count('_new')} < {LEAST_WORDS}, '', _new), {content_col})"))
    out = out.withColumn("words", F.expr(T.word_count("_new")))
    out = out.withColumn("_review", F.expr(f"IF(size(_block) = 0, array_sort(transform(filter(_found, f -> {prio('f')} > {BLOCK_PRIORITY}), f -> struct({prio('f')} AS p, f.ord AS ord, f.tag AS tag, f.reason AS reason))), NULL)"))
    kept_tag = "tag" if "tag" in chunks.columns else "'content'"
    out = out.withColumn("tag_reason", F.expr("IF(changed AND _new = '', 'everything was removed', coalesce(get(_review, 0).reason, ''))"))
    out = out.withColumn("tag", F.expr(f"IF(changed, 'content', coalesce(get(_review, 0).tag, {kept_tag}))"))
    return out.withColumn(content_col, F.col("_new")).drop("_new", "_found", "_block", "_review")


def custom_rules(chunks: DataFrame, rules: list[dict[str, str]], *, content_col: str = "content") -> DataFrame:
    """Chunks still tagged content get custom_block or custom_review by the first rule that matches: {pattern, action, reason}."""
    if not rules:
        return chunks
    tag = " ".join(f"WHEN {content_col} rlike {T.quote('(?i)' + r['pattern'])} THEN 'custom_{'block' if r.get('action') == 'block' else 'review'}'" for r in rules)
    why = " ".join(f"WHEN {content_col} rlike {T.quote('(?i)' + r['pattern'])} THEN {T.quote(r.get('reason') or 'custom rule')}" for r in rules)
    out = chunks.withColumn("_why", F.expr(f"IF(tag = 'content', CASE {why} END, NULL)")).withColumn("tag", F.expr(f"IF(tag = 'content', coalesce(CASE {tag} END, tag), tag)"))
    out = out.withColumn("tag_reason", F.coalesce("_why", "tag_reason")) if "tag_reason" in chunks.columns else out.withColumn("tag_reason", F.coalesce("_why", F.lit("")))
    return out.drop("_why")


def remediate(chunks: DataFrame, *, content_col: str = "content", found: str = "findings") -> DataFrame:
    """Rule part of remediation: chunks tagged editorial, placeholder or metadata_leak lose flagged sentences if ten words stay."""
    new = without_sentences(content_col, found)
    fits = f"tag in ('placeholder', 'metadata_leak', 'editorial') AND {T.word_count(new)} >= {LEAST_WORDS}"
    return chunks.withColumn("remediated", F.expr(fits)).withColumn(content_col, F.expr(f"IF(remediated, {new}, {content_col})"))


def counts(found: DataFrame) -> DataFrame:
    """Findings and chunks by detector and tag."""
    return found.groupBy("detector", "tag").agg(F.count("*").alias("findings"), F.countDistinct("doc_id").alias("documents"))
