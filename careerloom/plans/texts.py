"""Fixed values of the insight documents: titles, tags, query hints and sentences.

``{name}`` and the like are filled per person. The wording is part of the result
(documents are retrieved by it), so it is stated here as plain text.
"""

INSIGHTS = {
    "skill_gap": (
        "Hidden Skills — Claimed vs. Used Analysis",
        ("skills", "gaps", "hidden", "undersold", "capabilities", "resume"),
        (
            "what skills am I missing", "hidden skills", "undersold capabilities", "what am I not claiming",
            "skills not on my resume", "what should I add to my resume", "unused skills", "skills I don't list",
        ),
    ),
    "career_topology": (
        "Career Topology — What Connects Different Roles",
        ("topology", "bridges", "connections", "continuity", "career thread"),
        (
            "what connects my roles", "career through-line", "bridge skills", "how are my jobs related",
            "career continuity", "what ties my experience together",
        ),
    ),
    "tech_evolution": (
        "Technology Evolution — How the Toolkit Changed Over Time",
        ("timeline", "evolution", "tools", "technology", "progression"),
        (
            "how have my tools changed", "technology timeline", "tech stack history", "what tools have I used",
            "career progression technology",
        ),
    ),
    "hierarchy_map": (
        "Skill Hierarchy — SKOS Taxonomy Structure",
        ("hierarchy", "taxonomy", "SKOS", "skill relationships", "broader", "narrower"),
        ("how do my skills relate", "skill hierarchy", "skill taxonomy", "skill categories", "what falls under what"),
    ),
    "esco_coverage": (
        "ESCO Interoperability — Global Skill Identifiability",
        ("ESCO", "interoperability", "linked data", "semantic web", "global skills"),
        (
            "interoperability", "ESCO skills", "globally identifiable", "linked data coverage",
            "semantic web skills", "how portable is my profile",
        ),
    ),
    "role_progression": (
        "Role Progression — Career Arc and Trajectory",
        ("career", "progression", "trajectory", "roles", "arc", "timeline"),
        (
            "career path", "role history", "career trajectory", "job progression", "career arc",
            "work history", "professional experience",
        ),
    ),
}

GAP_HEAD = (
    "{name}'s resume declares **{claimed} skills**, but job history references **{used} distinct technologies** "
    "— with only **{both}** appearing in both lists ({overlap}). "
    "This reveals a gap between professional identity and documented experience."
)
GAP_USED = (
    "Technologies {name} has hands-on experience with but doesn't claim as skills. "
    "They may represent expertise taken for granted, or capabilities deliberately "
    "dropped from the current professional identity."
)
GAP_CLAIMED = (
    "Skills declared on the resume but never linked to a specific role. "
    "They may be cross-cutting competencies used everywhere, soft skills, "
    "or areas that need stronger grounding in concrete job descriptions."
)

TOPOLOGY_NONE = (
    "Across **{jobs} roles** and **{techs} technologies**, {name}'s career graph has **no bridge technologies** "
    "— no single technology appears in more than one role. Each career chapter used an entirely different toolkit."
)
TOPOLOGY_FEW = (
    "Out of **{techs} technologies** used across **{jobs} roles**, only **{bridges}** ({names}) appear in more than "
    "one job. Career continuity is **not** at the tooling level — each transition involved a near-complete "
    "technology stack change."
)
TOPOLOGY_MANY = (
    "{name}'s career shows **{bridges} bridge technologies** ({names}) connecting roles across **{jobs} positions**."
)
TOPOLOGY_BRIDGES = "Technologies appearing in multiple roles — the connective tissue of the career:"
TOPOLOGY_ISOLATED = "Roles with no shared technology with any other position:"
TOPOLOGY_MEANING = (
    "**The implication:** {name}'s value proposition is methodological and analytical, not tool-specific. "
    "The career demonstrates adaptability — picking up whatever tools each domain requires rather than building "
    "identity around a single technology stack."
)

EVOLUTION_HEAD = (
    "{name}'s technology toolkit has evolved across **{jobs} roles**, with major shifts at each career transition."
)
NO_TOOLS = "*(no technologies listed)*"
CURRENT = " ← **CURRENT**"

HIERARCHY_HEAD = (
    "{name}'s graph contains **{total} skills**. **{matched} ({pct}%)** matched to ESCO skill categories, "
    "enabling standardized grouping by the European Skills/Competences taxonomy. "
    "The remaining **{unmatched}** are vendor-specific tools, niche platforms, or emerging technologies "
    "not yet in the ESCO taxonomy."
)
HIERARCHY_GROUPS = (
    "Each group below is a real ESCO broader concept — not a keyword pattern, but a node in the European skill taxonomy:"
)
HIERARCHY_OTHER = (
    "These skills have no direct match in the ESCO taxonomy. They are often vendor-specific products "
    "(AWS, Salesforce), emerging tools (LangChain, Databricks), or domain jargon that ESCO hasn't yet incorporated:"
)
HIERARCHY_CATEGORIES = "Categories assigned during resume extraction — complements the ESCO grouping above:"

COVERAGE_HEAD = (
    "**{pct}%** of {name}'s skills (**{linked}/{total}**) are linked to ESCO "
    "(European Skills/Competences/Occupations) URIs — making them globally identifiable across any "
    "ESCO-aligned system."
)
COVERAGE_PATTERN = (
    "**Pattern:** {name}'s foundational and well-known skills are globally identifiable, but specialized "
    "differentiating skills (domain tools, niche platforms) are string-only. In a cross-system search, someone "
    "looking for specific expertise would only find this profile through exact string matching — not semantic "
    "discovery."
)

PROGRESSION_HEAD = (
    "{name}'s career spans **{jobs} roles** from **{first}** to present, with **{titles} distinct titles**."
)
PROGRESSION_EMPTY = "{name}'s graph lists no roles yet."
PROGRESSION_TITLE = (
    "- **'{title}'** appears multiple times — suggesting either a return to a familiar role type or consistent "
    "professional identity."
)
PROGRESSION_LOYALTY = (
    "**{orgs} organization(s)** appear in multiple roles — indicating return engagements or long-term client "
    "relationships."
)

# Tags and hints of a narrative document.
NARRATIVE_TAGS = ("narrative", "synthesis", "cross-cutting", "career story", "positioning")
NARRATIVE_HINTS = (
    "tell me about my career",
    "what makes my background unique",
    "career narrative",
    "big picture",
    "how does my experience fit together",
    "what story does my career tell",
    "professional positioning",
    "career themes",
)
