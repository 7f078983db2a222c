"""Word lists and small dimensions."""

from __future__ import annotations

#: Words that say nothing about a topic.
COMMON = sorted("""
about above after again all already also always and another any are been before being below between both but can check
contact could details due each either ensure even every first follow for from gets get give gives has had have here how
include information into issues its just keep keeps last less make makes many may more most much must need never
new next not note often old only other our page per please process provide quite same second section see set sets
should some sometimes steps still such take takes than that the their then there these this those too try use used
usually very was well were what when where which who why will with work works would yet you your
""".split())
#: The same for vocabularies of a whole corpus.
COMMON_CORPUS = COMMON + "available based currently following using within without".split()
COMMON_CONTENT = sorted("all also and any are been can each for from has have may more must not our per should that the this was will with your".split())
COMMON_HEADING = "and for from new old our the updated with".split()
GENERIC_CONTEXT = sorted("""
within with will up total to times time the service process period per payments payment over our on of number new
may is in from for each date customers customer can by before based at are an amount all after account a plan
""".split())

#: Capitals that look like acronyms but aren't.
NOT_ACRONYMS = sorted("""
WORK WITH WILL WHEN USE TRY TODO THIS THEY THEM THE THAT TAKE STEP SET RUN PUT PLAN OUT ONLY OLD NOW NOTE NOT NEW MUST
MARCH MAKE LEVEL LET KEEP JUNE JULY HAVE GIVE GET FROM FOR FIND EACH DRAFT DONE DOES CLICK CHANGE CASE CALL BEEN ANY AND
ALSO ALL ADD APRIL
""".replace("TODO", "").split())
NOT_ACRONYMS_IN_TEXT = sorted("""
XXX WITH WILL WHEN UTC USE TODO THIS THE THAT TBD STEP SET PST PLAN PAY ONLY NOTE NOT MUST LEVEL JIRA HAVE HACK GMT GET FROM
FOR FIXME ETA EST ERR EACH DRAFT CHANGE CASE CALL BEEN AND ALSO ALL
""".split())
EVERYDAY_ACRONYMS = sorted("XML VS VP USD USA US URL UN UK TB PM PDF OK NA MB KB JSON IT ID HTTPS HTTP HTML HR GB FAQ EUR EU CTO CSV COO CFO CEO API AM".split())
#: Capitalised words that name nobody.
TITLE_WORDS = sorted("""
Your Yes Where When What Value Type Those This These The That Table Summary Step Status September Section Resolution Process Our October
November Note None Method May March Level June July January Issue How For Figure Field Feature February December Custom Content Contact Code Case
August April All Active
""".split())
EXPANSIONS = dict(x.split("=") for x in (
    "VPN=Virtual Private Network", "SWIFT=Society for Worldwide Interbank Financial Telecommunication", "SSO=Single Sign-On", "SLA=Service Level Agreement",
    "PO=Purchase Order", "PII=Personally Identifiable Information", "MFA=Multi-Factor Authentication", "KPI=Key Performance Indicator",
    "DPO=Data Protection Officer", "CVV=Card Verification Value", "CSM=Customer Success Manager", "CRM=Customer Relationship Management",
))

#: Domain, in order of precedence, and the words that point to it.
DOMAINS = (
    ("support", "agent assist billing case customer escalate escalation help issue refund resolution resolve subscription support ticket troubleshoot"),
    ("medical", "clinical diagnosis doctor dosage hospital medication nurse patient prescription symptom therapy treatment"),
    ("legal", "agreement arbitration breach clause compliance contract indemnity liability obligation regulation statute"),
    ("engineering", "api database deployment endpoint microservice migration pipeline repository schema server"),
    ("finance", "asset budget dividend equity fiscal forecast investment liability portfolio quarterly revenue"),
    ("hr", "benefits compensation employee leave onboarding payroll performance recruitment termination"),
)
DOMAIN_ACRONYMS = {
    "support": "CRM CSM SLA CSAT=Customer Satisfaction Score;NPS=Net Promoter Score",
    "medical": "EHR=Electronic Health Record;PHI=Protected Health Information;HIPAA=Health Insurance Portability and Accountability Act",
    "legal": "GDPR=General Data Protection Regulation;NDA=Non-Disclosure Agreement",
    "engineering": "SDK=Software Development Kit;CI=Continuous Integration;API=Application Programming Interface",
    "finance": "KPI ROI=Return on Investment",
    "hr": "HRIS=Human Resources Information System;PTO=Paid Time Off",
}
DOMAIN_ACTORS = {
    "support": "billing finance support", "medical": "doctor=physician nurse=nursing patient=patient", "legal": "compliance counsel=legal",
    "engineering": "devops engineering", "finance": "cfo=finance controller=finance", "hr": "hr recruiter=hr",
}
NOT_ACTORS = sorted("your this they them the that system relevant refund platform payment out our most management it issue customer appropriate any all account".split())

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_NAMES = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"


def domain_defaults(domain: str) -> dict[str, dict[str, str]]:
    """Acronyms and actors to begin with in a domain."""
    acronyms = {}
    for part in DOMAIN_ACRONYMS.get(domain, "").split(";"):
        *known, rest = part.split(" ", part.split("=")[0].count(" ")) if part else ("",)
        acronyms |= {k: EXPANSIONS[k] for k in known}
        if "=" in rest:
            k, v = rest.split("=")
            acronyms[k] = v
        elif rest:
            acronyms[rest] = EXPANSIONS[rest]
    actors = dict((a.split("=") * 2)[:2] for a in DOMAIN_ACTORS.get(domain, "").split())
    return {"acronyms": acronyms, "actors": actors}
