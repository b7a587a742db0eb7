"""Canonical addresses inferred from the name and id of a component."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: publications with an address of their own ------------------------------------------------
SPECIAL_PUBLICATIONS = {
    "800-53": "800-53/rev-5", "800-171": "800-171/rev-2", "800-37": "800-37/rev-2", "800-30": "800-30/rev-1", "800-39": "800-39",
    "800-61": "800-61/rev-2", "800-115": "800-115", "800-82": "800-82/rev-2", "800-88": "800-88/rev-1", "800-34": "800-34/rev-1",
    "800-122": "800-122", "800-207": "800-207", "800-53A": "800-53a/rev-5", "800-63": "800-63/rev-3", "800-63A": "800-63a/rev-3",
    "800-63B": "800-63b/rev-3", "800-63C": "800-63c/rev-3", "800-218": "800-218", "800-160": "800-160/rev-1", "800-184": "800-184",
    "800-144": "800-144", "800-137": "800-137", "800-55": "800-55/rev-1", "800-53B": "800-53b", "800-125": "800-125", "800-124": "800-124/rev-2",
}
#: Pattern and address, tried in this order; $1 and $2 are groups of the pattern. Where a third part is given, its pattern is
#: held against the first match, and its address taken where that fits.
BEFORE = [
    (r"(\d+)\s*USC\s*([0-9A-Za-z\-]+)", "https://uscode.house.gov/view.xhtml?req=(title:$1%20section:$2)"),
    (r"(\d+)\s*CFR\s*([0-9]+(?:\.[0-9]+)?)", "https://www.ecfr.gov/current/title-$1/part-$2", (r"\.", "https://www.ecfr.gov/current/title-$1/section-$2")),
    (r"\bFAR\s*([0-9]+)(?:\.[0-9]+)?", "https://www.acquisition.gov/far/part-$1"),
    (r"\bDFARS\s*([0-9]+)(?:\.[0-9]+)?", "https://www.acquisition.gov/dfars/part-$1"),
    (r"\bExecutive Order\s*(\d+)\b", "https://www.archives.gov/federal-register/executive-orders/$1.html"),
    (r"OMB\s*Circular\s*A-?(\d+)", "https://www.whitehouse.gov/omb/information-for-agencies/circulars/"),
    (r"\bM-\d{2}-\d{2}\b", "https://www.whitehouse.gov/omb/information-resources/guidance/memoranda/", (r"(?i)M-26-03", "https://www.whitehouse.gov/wp-content/uploads/2025/12/M-26-03-Presidents-Management-Agenda.pdf")),
]
AFTER = [
    (r"\bFIPS\s*(199|200)\b", "https://csrc.nist.gov/publications/detail/fips/$1/final"),
    (r"FISMA", "https://www.cisa.gov/topics/risk-management/federal-information-security-modernization-act"),
    (r"HIPAA", "https://www.hhs.gov/hipaa/index.html"),
    (r"FERPA", "https://www2.ed.gov/policy/gen/guid/fpco/ferpa/index.html"),
    (r"Privacy Act", "https://www.justice.gov/opcl/privacy-act-1974"),
    (r"Paperwork Reduction Act", "https://www.whitehouse.gov/omb/information-regulatory-affairs/paperwork-reduction-act/"),
    (r"Clinger[- ]Cohen", "https://www.gsa.gov/policy-regulations/policy/information-integrity-and-access/clingercohen-act"),
    (r"Federal Register", "https://www.federalregister.gov/"),
    (r"NARA Bulletin\s*(\d{4}-\d{2})", "https://www.archives.gov/records-mgmt/bulletins/$1.html"),
    (r"GAO Report\s*(GAO-\d+-\d+)", "https://www.gao.gov/products/$1"),
    (r"OMB Bulletin\s*(\d{4}-\d{2})", "https://www.whitehouse.gov/omb/information-for-agencies/bulletins/$1"),
    (r"DHS Directive\s*(\d{4}-\d{2})", "https://www.dhs.gov/publication/dhs-directive-$1"),
    (r"DoD Instruction\s*(\d+\.\d+)", "https://www.esd.whs.mil/Portals/54/Documents/DD/issuances/dodi/$1.pdf"),
    (r"\bTitle\s*VII\b|\bCivil\s*Rights\s*Act\b", "https://www.eeoc.gov/statutes/title-vii-civil-rights-act-1964"),
    (r"\bFSIS\s*Notice\s*(\d{4}-\d{2})\b", "https://www.fsis.usda.gov/policy/fsis-notices/$1"),
    (r"\bFSIS\s*(?:Directive)?\s*(\d{4,}\.?[0-9]*)\b", "https://www.fsis.usda.gov/policy/fsis-directives/$1"),
    (r"\bAMS Administrative Issuances\b", "https://www.ams.usda.gov/about-ams/policies/ams-issuances"),
    (r"\bAfrican\s*Swine\s*Fever\b|\bASF\b", "https://www.aphis.usda.gov/animal-emergencies/asf"),
    (r"\bAPHIS\s*Directive\b", "https://www.aphis.usda.gov/aphis/ourfocus/business-services/directives"),
    (r"\bFarmers\s*First\b", "https://www.usda.gov/sites/default/files/documents/farmers-first-small-family-farms-policy-agenda.pdf"),
]
# ----------------------------------------------------------------------------------------------------------


def canonical_url(name: Column, component_id: Column) -> Column:
    """The address of the first rule that the name and id match, a search where none does, null for empty texts.

    A rule's address is built from what its own match holds, so several rules in one text do not mix.
    """
    text = F.trim(F.concat_ws(" ", F.coalesce(name.cast("string"), F.lit("")), F.coalesce(component_id.cast("string"), F.lit(""))))
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)\bEO\b", "Executive Order"), r"(?i)\bSP\s*800\b", "NIST SP 800")

    def rule(pattern: str, address: str, special: tuple[str, str] | None = None) -> Column:
        p = "(?i)" + pattern
        match = F.regexp_extract(text, p, 0)
        built = lambda a: F.regexp_replace(match, p, a) if "$" in a else F.lit(a)
        return F.when(text.rlike(p), F.when(match.rlike(special[0]), built(special[1])).otherwise(built(address)) if special else built(address))

    number = F.nullif(F.regexp_extract(text, r"(?i)SP\s*800-([0-9]+[A-Za-z]?)", 1), F.lit(""))
    table = F.create_map(*[F.lit(x) for kv in SPECIAL_PUBLICATIONS.items() for x in kv])
    place = F.element_at(table, F.concat(F.lit("800-"), number))
    special = F.when(number.isNotNull(), F.coalesce(F.concat(F.lit("https://csrc.nist.gov/publications/detail/sp/"), place, F.lit("/final")), F.lit("https://csrc.nist.gov/publications/sp800")))
    search = F.when(text != "", F.concat(F.lit("https://www.google.com/search?q=site:.gov+"), F.regexp_replace(text, r"\s+", "+")))
    return F.coalesce(*[rule(*r) for r in BEFORE], special, *[rule(*r) for r in AFTER], search)
