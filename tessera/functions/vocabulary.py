"""The marker vocabularies every detector reads.

All of these are constants that decide results, so they are stated here
together and as plain text.  Patterns are plain strings (never columns), so that
Spark compiles each of them once per task.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# Five analytical perspectives
# --------------------------------------------------------------------------
PERSPECTIVES = {
    "causes": (
        r"(?i)\b(?:because|due\s+to|driven\s+by|caused?\s+by|as\s+a\s+result|led\s+to"
        r"|attributed\s+to|resulting\s+from|stems?\s+from|owing\s+to|fueled\s+by|spurred\s+by"
        r"|triggered\s+by|enabled\s+by|on\s+the\s+back\s+of|thanks\s+to|a\s+result\s+of"
        r"|driv(?:ing|es?)|caus(?:ing|es)|lead(?:ing|s)\s+to|contribut(?:ing|es?)\s+to"
        r"|result(?:ing|s)\s+(?:in|from)|explains?\s+(?:why|how)|accounts?\s+for|responsible\s+for"
        r"|plays?\s+a\s+(?:role|part)\s+in)\b"
    ),
    "risks": (
        r"(?i)\b(?:risks?|threats?|challenges?|concerns?|vulnerab\w*|downsides?|obstacles?"
        r"|barriers?|limitations?|constraints?|dangers?|warnings?|caveats?|drawbacks?"
        r"|disruptions?|headwinds?|pressure[ds]?|declin(?:e[ds]?|ing)|fragil\w*|expos\w+\s+to"
        r"|bottlenecks?|adverse\s+(?:events?|effects?|reactions?|outcomes?)|shortages?"
        r"|side\s+effects?|complications?|discontinued|discontinuation|recalls?|failures?)\b"
    ),
    "stakeholders": (
        r"(?i)\b(?:affects?|impacts?|benefits?|harms?|stakeholders?|populations?|workforce"
        r"|residents|displaced|communities|consumers?|workers?|investors?|patients?"
        r"|participants?|employees?|taxpayers?|households?|citizens?|users?|regulators?"
        r"|insurers?|payers?|physicians?|customers?|shareholders?|analysts?|(?:lower"
        r"|low|high|middle)[- ]income|providers?|suppliers?|manufacturers?|competitors?"
        r"|partners?|vendors?|clients?|subscribers?)\b"
    ),
    "trends": (
        r"(?i)\b(?:grow(?:ing|th|n|s)?|grew|decline[ds]?|declining|increas(?:e[ds]?"
        r"|ing|ingly)|decreas(?:e[ds]?|ing)|r(?:ising|ose|isen)|f(?:alling|ell|allen)"
        r"|surg(?:e[ds]?|ing)|expand(?:ed|ing|s)?|expansion|shrink(?:ing|s)?|shrank"
        r"|contract(?:ed|ing|ion)|shift(?:ing|ed|s)?|emerg(?:ing|ed|ence)|transitioning"
        r"|increasingly|trends?|trajectory|momentum|acceleration|evolution|transformation"
        r"|projected|forecast(?:ed)?|outlook)\b"
    ),
    "uncertainty": (
        r"(?i)\b(?:unclear|uncertain(?:ty)?|debated|contested|depends|varies|unpredictable"
        r"|unknown|estimated|approximate(?:ly)?(?!\s*[\d$%])|roughly(?!\s*[\d$%])"
        r"|open\s+question|remains\s+to\s+be\s+seen|not\s+(?:yet|fully)\s+(?:clear"
        r"|understood|determined)|concerns?\s+(?:about|over|remain|that)|questions?\s+(?:about"
        r"|whether|remain)|remains?\s+(?:unclear|uncertain|to\s+be\s+seen|limited"
        r"|insufficient|incomplete|open)|limited\s+(?:data|evidence|research)|insufficient\s+(?:data"
        r"|evidence)|long[- ]term\s+(?:safety|outcomes?|effects?|data|implications?)"
        r"|preliminary|inconclusive|unresolved|tentative|undemonstrated|unproven|theoretically\s+promising"
        r"|years\s+or\s+decades|no\s+credible\s+signs?|not\s+yet\s+clear|far\s+from\s+settled)\b"
    ),
}
DISMISSIBLE = ("risks", "uncertainty")

# --------------------------------------------------------------------------
# Hints that a perspective may be there under other words
# --------------------------------------------------------------------------
PERSPECTIVE_HINTS = {
    "causes": (
        r"(?i)\b(?:rationale|motivation|reason\s+(?:for|why|that)|centers?\s+on|given\s+(?:that"
        r"|the)|in\s+light\s+of|why\s+this|the\s+(?:driver|motive|impetus)\s+of|underpin(?:s"
        r"|ning|ned)|undergirds?)\b"
    ),
    "risks": (
        r"(?i)\b(?:worries|tensions|caution(?:ary)?|doubtful|questionable|ambiguit(?:y"
        r"|ies)|uncertainty\s+about\s+(?:safety|stability|outcomes))\b"
    ),
    "stakeholders": (
        r"(?i)\b(?:people\s+who|groups\s+(?:who|affected)|those\s+(?:who|affected"
        r"|involved|impacted)|anyone\s+who|the\s+public\b(?!\s+(?:web|domain|sphere"
        r"|record|opinion|sector|health|good|interest|eye|face|library|school|transport"
        r"|transit|safety))|members\s+of|individuals?\s+who)\b"
    ),
    "trends": (
        r"(?i)\b(?:restructuring|consolidation|diversification|maturation|shift(?:ing)?\s+in"
        r"|mov(?:ed|ing|ement)\s+(?:toward|away)|develop(?:ed|ing|ment)\s+(?:into"
        r"|of|toward)|outlast(?:ing|ed)?|endur(?:e[ds]?|ing|ance))\b"
    ),
    "uncertainty": (
        r"(?i)\b(?:might\s+(?:be|have)|perhaps(?!\s+(?:the|a|an)\s+(?:most|least|best"
        r"|worst|first|last|defining|leading|dominant|primary|central|key|main|chief"
        r"|top|greatest))|possibly|conceivably|some\s+doubt|open\s+to\s+(?:debate"
        r"|question|interpretation)|it\s+is\s+(?:possible|plausible)\s+that)\b"
    ),
}

# --------------------------------------------------------------------------
# Words that play a risk down, and their windows in characters
# --------------------------------------------------------------------------
DIMINISHER = (
    r"(?i)\b(?:minimal|negligible|minor|few|limited|overblown|unlikely|manageable"
    r"|low|slight|marginal|trivial|insignificant|immaterial|modest|remote|hypothetical"
    r"|overstated|exaggerated|no\s+(?:real|significant|major|meaningful|known"
    r"|identified|material|apparent|notable|elevated|unresolved|remaining|critical"
    r"|substantive|credible|immediate|direct|evident)|eliminat\w*\s+(?:all|any"
    r"|every))\b"
)
NEGATION_BEFORE = (
    r"(?i)(?:\b(?:no|zero|without\s+any|free\s+(?:of|from)|absence\s+of|lack\s+of)"
    r"(?:\s+\w+){0,1}|\bwithout)\s*$"
)
DIMINISHER_BEFORE = 60
NEGATION_WINDOW = 20
DIMINISHER_AFTER = 80
DIMINISHER_AFTER_MAX = 1000

# --------------------------------------------------------------------------
# Time orientation
# --------------------------------------------------------------------------
PAST = (
    r"(?i)\b(?:was|were|had|did|grew|declined|fell|rose|reached|exceeded|dropped"
    r"|increased|decreased|experienced|started|launched|announced|released|reported"
    r"|disclosed|filed|published|stated|confirmed|completed|finished|achieved"
    r"|acquired|divested|merged|sold|bought|invested|spent|hired|fired|retired"
    r"|joined|departed|resigned|named|appointed|closed|opened|expanded|contracted"
    r"|shifted|moved|relocated|followed|preceded|occurred|happened|took\s+place"
    r"|went|came|saw|made|took|gave|found|knew|became|said|told|introduced|unveiled"
    r"|debuted|in\s+20[01]\d|in\s+201\d|in\s+202[0-6]|last\s+year|previously|historically"
    r"|traditionally|formerly|originally|initially|earlier)\b"
)
FUTURE = (
    r"(?i)\b(?:will|shall|projected|forecast|expected\s+to|anticipated|predicts?"
    r"|estimates?\s+(?:that|a)|by\s+202[7-9]|by\s+20[3-9]\d|going\s+forward|in\s+the\s+(?:coming"
    r"|next)|outlook|poised\s+to|set\s+to|on\s+track)\b"
)

# --------------------------------------------------------------------------
# voice
# --------------------------------------------------------------------------
YOU = r"(?i)\byou(?:r|rs?)?\b"
WE = r"(?i)\b(?:we|our|us)\b"
IMPERATIVE = (
    r"(?i)^(?:use|try|test|start|stop|wait|check|avoid|apply|ensure|verify|compare|review"
    r"|monitor|scroll|pause|log|look|act|buy|sell|invest|allocate|consider|evaluate|assess"
    r"|focus|pivot|read|switch|move|add|remove|choose|pick|get|take|do not|don't|never"
    r"|always|make sure|be sure)\b"
)
SPECIFICATION = (
    r"(?i)(?:size|weight|length|height|lifespan|habitat|distribution|attributes?|range|depth"
    r"|diameter|density|capacity|speed)\s*[:/]"
)
PROMOTION = (
    r"(?i)\b(?:unprecedented|extraordinary|exceptional|remarkable|transformative"
    r"|revolutionary|game[- ]chang\w+|substantial\s+opportunit\w+|tremendous|massive\s+opportunit\w+"
    r"|bullish|exciting|impressive|robust\s+growth|record(?:[- ]breaking)?|soaring"
    r"|skyrocket\w+|dominat\w+|leading\s+the\s+way|best[- ]in[- ]class|unparalleled"
    r"|world[- ]class|cutting[- ]edge|creating\s+(?:substantial|significant|enormous)\s+opportunit\w+)\b"
)

# --------------------------------------------------------------------------
# attribution
# --------------------------------------------------------------------------
SOURCE_MARKER = (
    r"(?i)\b(?:according\s+to|sources?|cited?|stud(?:y|ies)|research(?:ers?)?"
    r"|evidence|peer.reviewed|journals?|surveys?|surveyed|findings?|data\s+(?:from"
    r"|shows?|suggests?)|analysis\s+(?:by|from)|estimates?\s+(?:by|from)|(?:clinical\s+)?trial(?:s)?"
    r"|meta.analys[ie]s|systematic\s+review|(?:stud(?:y|ies)|research|surveys?"
    r"|reports?|papers?)\s+(?:show|shows|showed|suggest|suggests|suggested|find"
    r"|finds|found|conclude|concluded|reveal|reveals|revealed))\b"
)
REPORTING_VERBS = (
    r"(?:reported|reports|announced|announces|published|publishes|stated|states"
    r"|disclosed|discloses|confirmed|confirms|filed|files)"
)
NAMED_REPORTER = r"([A-Z][a-zA-Z]+(?:\.?\s+[A-Z][a-zA-Z]+){0,3})\.?\s+" + REPORTING_VERBS
NOT_A_REPORTER = (
    "this that these those we our us they their them it its he she his her i my "
    "some many all most several each every both either neither "
    "company firm group team department organization corporation business "
    "author authors writer writers article document report paper "
    "however therefore furthermore moreover additionally "
    "recently currently previously historically first second third finally"
).split()
NUMERIC = r"(?i)\d+(?:\.\d+)?(?:\s*%|\s*[xX]|\s*billion|\s*million|\s*trillion)"
CITATION_HINT = (
    r"(?i)\[(?:[A-Z][a-zA-Z]+(?:\s+(?:et\s+al\.?|and\s+[A-Z][a-zA-Z]+))?(?:,?\s+\d{4})?|\d{1,3})\]"
    r"|\((?:[A-Z][a-zA-Z]+(?:\s+(?:et\s+al\.?|and\s+[A-Z][a-zA-Z]+))?[,;]?\s+\d{4}[a-z]?)\)"
    r"|(?-i:\([A-Z]{2,}\b\s*[,;:]\s*[^)]{1,250}\))"
    r"|(?-i:\([A-Z]{2,}\b[^)]{0,250}?\b\d{4}\b[^)]{0,100}?\))"
    r"|(?-i:\([A-Z][a-zA-Z]+\s+[A-Za-z][a-zA-Z]+[^)]{0,250}?\b\d{4}\b[^)]{0,100}?\))"
    r"|\b(?:observers\s+(?:raise|note|have\s+noted|argue)"
    r"|analysts\s+(?:argue|note|have\s+argued|observe)"
    r"|researchers\s+(?:have\s+(?:found|shown|argued|noted)|find)"
    r"|scholars\s+(?:have\s+(?:argued|noted)|argue|note)"
    r"|commentators\s+(?:have\s+(?:argued|noted|suggested))"
    r"|critics\s+(?:have\s+(?:argued|noted))"
    r"|some\s+have\s+(?:argued|suggested|noted))\b"
    r"|\bper\s+(?:the|a|this|that)\s+(?:filing|report|study|paper|article|findings|analysis"
    r"|document|source|dataset|survey|statement|announcement)\b"
    r"|\bas\s+reported\s+(?:in|by)\b|\bpublished\s+(?:in|by|at)\b"
    r"|\b(?:see|cf\.?)\s+(?:Section|Table|Figure|Appendix|reference\s*\[?\s*\d+)\b"
)
FOOTNOTE_NUMBER = r"\[\d{1,3}\]"

# --------------------------------------------------------------------------
# Reasoning style and registers
# --------------------------------------------------------------------------
MECHANISM = (
    r"(?i)\bbecause\b|\bcauses\b|\bleads?\s+to\b|\bresults?\s+in\b|\bdue\s+to\b"
    r"|\bdriven\s+by\b|\bmediated\s+by\b|\bthrough\s+the\s+mechanism\b|\bcontributes?\s+to\b"
    r"|\bstems?\s+from\b|\bconsequently\b|\btherefore\b|\bthus\b|\bcreates?\s+(?:a"
    r"|an|the)\b|\bprevents?\s+(?:a|an|the|this|that)\b|\bundermines?\b|\breinforces?\b"
    r"|\bexacerbates?\b|\btriggers?\b|\breduces?\s+(?:a|an|the|this|that)\b|\bincreases?\s+(?:a"
    r"|an|the|this|that)\b|\bdepends?\s+on\b|\bin\s+response\s+to\b"
)
BUZZWORD = (
    r"(?i)\bfundamentally\b|\binherently\b|\bexponentially\b|\btransformative\b"
    r"|\bparadigm\b|\bsynerg(?:y|istic)\b|\bholistically\b|\bleverage\b(?=\s+(?:the"
    r"|this|that|our|their|your|its|a|an|existing|new|current|available|key|core"
    r"|unique|critical|strategic|digital|modern|data|technology|AI|cloud))|\bosmosis\b"
    r"|\bseamlessly\b|\brobust\b(?=\s+(?:framework|solution|approach|system))"
    r"|\bcomprehensive\b(?=\s+(?:framework|solution|approach|strategy))|\bcritical(?:ly)?\s+important\b"
    r"|\bgame.?changer\b|\bpivotal\b"
)
REGISTERS = {
    "assertion": (
        r"(?i)\bmust\b|\balways\b|\bnever\b|\bundeniably\b|\bclearly\b|\bobviously\b"
        r"|\bensures?\b|\bguarantees?\b|\brequires?\b|\bwill\s+(?:lead|result|cause"
        r"|create|produce)\b|\bis\s+essential\b|\bis\s+critical\b|\bis\s+(?:the\s+)?key\b"
    ),
    "qualified": (
        r"(?i)\btends?\s+to\b|\bin\s+many\s+cases\b|\bevidence\s+suggests?\b|\boften\b"
        r"|\btypically\b|\bgenerally\b|\busually\b|\bfrequently\b|\bcan\s+(?:lead"
        r"|result|cause|help)\b|\bmay\s+(?:lead|result|cause|help|be|not)\b|\blikely\b"
        r"|\bprobably\b"
    ),
    "conditional": (
        r"(?i)\bwhen\s+\w+\s+(?:is|are|do|does|have|has)\b|\bif\s+(?:the|this|a|an"
        r"|these|those)\b|\bdepending\s+on\b|\bassuming\b|\bin\s+(?:cases|situations"
        r"|contexts)\s+where\b|\bprovided\s+that\b|\bunder\s+(?:conditions|circumstances)\b"
        r"|\bwhether\b"
    ),
    "evidenced": (
        r"(?i)\bstudies?\s+(?:show|indicate|suggest|find|found|demonstrate)\b|\bresearch\s+(?:show"
        r"|indicate|suggest|find|found|demonstrate)s?\b|\bdata\s+(?:show|indicate"
        r"|suggest|reveal)s?\b|\baccording\s+to\b|\bempirical(?:ly)?\b|\bobserved\b"
        r"|\bmeasured\b|\bevidence\s+(?:from|shows?|indicates?|suggests?)\b"
    ),
    "speculative": (
        r"(?i)\bmight\b|\bcould\s+(?:be|lead|result|have|create|potentially)\b|\bpossibly\b"
        r"|\bperhaps\b|\bremains?\s+to\s+be\s+seen\b|\bit\s+is\s+(?:possible|plausible"
        r"|conceivable)\b|\bspeculat(?:e|ive|ion)\b|\bhypothes(?:is|ize|etical)\b"
    ),
}
RELIABLE_REGISTER_HITS = 10

# --------------------------------------------------------------------------
# Typed numbers inside one sentence, and causal sentences
# --------------------------------------------------------------------------
SENTENCE_NUMBERS = [
    ("percentage", r"(?i)(?:~|approximately |about |roughly |nearly |over |under )?(\d+(?:\.\d+)?)\s*%"),
    ("pct_range", r"(?i)(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)\s*%"),
    ("dollar", r"(?i)[$€£¥₹]\s*(\d+(?:[.,]\d+)*)\s*(billion|million|thousand|bn|mn|B|M|K)?"),
    ("multiplier", r"(?i)(\d+(?:\.\d+)?)\s*[x×](?:\s|$|,)"),
    ("multiplier", r"(?i)(\d+(?:\.\d+)?)\s*-?\s*fold"),
    ("entity_count",
     r"(?i)(\d+(?:,\d{3})*)\s+(?:companies|firms|teams|organizations|employees|engineers"
     r"|developers|users|customers|tools|platforms|products|projects|systems|failures"
     r"|incidents|outages|services|applications|repositories|modules|microservices"
     r"|endpoints|APIs?|databases?|clusters?|regions?)"),
    ("duration",
     r"(?i)(\d+(?:\.\d+)?)\s*[-–]?\s*(?:\d+(?:\.\d+)?\s*)?"
     r"(?:days?|weeks?|months?|years?|hours?|minutes?|quarters?|sprints?)"),
]
CAUSAL_SENTENCE = (
    r"(?i)\bbecause\b|\bsince\b(?!\s+\d)|\bdue to\b|\bowing to\b|\bas a result of\b"
    r"|\bcaused? by\b|\bdriven by\b|\bleads? to\b|\bresults? in\b|\bcauses?\b|\bproduces?\b"
    r"|\bgenerates?\b|\btriggers?\b|\bconsequently\b|\btherefore\b|\bthus\b|\bhence\b"
    r"|\bthe (?:primary|main|key|root|fundamental|core|underlying|central) "
    r"(?:cause|reason|driver|factor|mechanism|force)\b"
    r"|\b(?:directly|indirectly) (?:causes?|leads? to|results? in|drives?)\b"
    r"|\bis responsible for\b|\baccounts? for\b|\benables?\b|\bprevents?\b|\binhibits?\b"
    r"|\bfacilitates?\b|\bexacerbates?\b|\bcompounds?\b(?:\s+the)|\bamplifies?\b"
    r"|\breinforces?\b|\bundermines?\b|\berodes?\b"
)

# Typed numbers anywhere in a text, in order of priority.
# (mention type, reported type, pattern)
TEXT_NUMBERS = [
    ("percentage", "percentage", r"(\d+(?:\.\d+)?)\s*%"),
    ("dollar", "dollar", r"[$€£¥₹](\d+(?:\.\d+)?(?:,\d{3})*)"),
    ("dollar_range", "dollar",
     r"[$€£¥₹](\d+(?:\.\d+)?(?:,\d{3})*)\s*[-–]\s*[$€£¥₹]?(\d+(?:\.\d+)?(?:,\d{3})*)\s*([MBKmillion|billion|thousand]*)"),
    ("multiplier", "multiplier", r"(\d+(?:\.\d+)?)[xX]\b"),
    ("scaled_integer", "integer",
     r"(?<![$€£¥₹])(?<!\d)(?<!\.)(\d+(?:\.\d+)?)\s+(thousand|million|billion|trillion)\b"),
    ("decimal", "decimal", r"(?<![$€£¥₹])(?<!\d)(\d+\.\d+)(?!%)"),
    ("integer_comma", "integer",
     r"(?<![$€£¥₹])(?<!\d)(?<!\.)(\d{1,3}(?:,\d{3})+)(?!\.\d)(?!%)(?!\d)"),
    ("integer_suffix", "integer", r"(?<![$€£¥₹])(?<!\d)(?<!\.)(\d+)\s*[MBK]\b"),
    ("integer", "integer",
     r"(?<![$€£¥₹])(?<!\d)(?<!\.)(\d{2,6})(?!\.\d)(?!%)(?!\d)(?!,\d{3})"),
]
SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}
YEAR_LOW, YEAR_HIGH = 1990, 2035

# --------------------------------------------------------------------------
# presentation
# --------------------------------------------------------------------------
STYLE_HEDGE = (
    r"(?i)\b(?:perhaps|maybe|possibly|might|could|seems?|appears?|suggest(?:s|ed|ing)?"
    r"|indicate(?:s|d)?|tend(?:s|ed)?|somewhat|relatively|generally|often|usually|typically"
    r"|in some cases|to some extent|it (?:is|seems) (?:possible|likely))\b"
)
STYLE_ASSERT = (
    r"(?i)\b(?:always|never|must|requires?|demands?|guarantees?|ensures?|proves?"
    r"|demonstrates?|establishes?|confirms?|definitively|inevitably|invariably|necessarily"
    r"|fundamentally|critically|the (?:key|core|essential|primary|fundamental|root|central) "
    r"(?:issue|problem|cause|reason|driver|mechanism|factor))\b"
)
NAMED_CONCEPT = (
    r"(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\s*(?:Effect|Trap|Paradox|Principle|Syndrome|Pattern"
    r"|Loop|Cycle|Model|Framework|Law|Rule|Fallacy|Bias|Gap|Problem|Phenomenon|Spiral"
    r"|Ceiling|Floor|Threshold))"
)
ABBREVIATION = (
    r"\b(U\.S|vs|Dr|Mr|Mrs|Ms|Jr|Sr|Inc|Ltd|Corp|etc|approx|est|i\.e|e\.g|Prof|Gen|Gov|Sen"
    r"|Rep|Sgt|Rev|Vol|No|Fig|Eq|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\."
)
STOP_WORDS = (
    "a an the and or but if in on at to for of with by from as is are was were "
    "be been being have has had do does did will would shall should can could "
    "may might must need not no nor so yet also just only even still already "
    "than then that this these those it its he she they them their his her we "
    "our you your i me my which what when where who whom how why all each "
    "every any some most more less much many few several both either neither "
    "into onto upon about above below between through during before after "
    "since until while however therefore moreover furthermore although because "
    "versus via per etc vs often very quite rather too such like"
).split()

# --------------------------------------------------------------------------
# Assertions that ask for grounding, and names from outside
# --------------------------------------------------------------------------
FIRM_ASSERTION = REGISTERS["assertion"] + "|" + (
    r"(?i)\bit\s+is\s+clear\s+that\b|\bthere\s+is\s+no\s+doubt\b|\bwithout\s+(?:question"
    r"|doubt|exception)\b|\bproves?\s+(?:that|beyond)\b|\bindisputabl[ye]\b|\bconclusivel[ye]\b"
    r"|\bunambiguous(?:ly)?\b|\bdefinitiv(?:e|ely)\b|\binevitabl[ye]\b|\bunquestionabl[ye]\b"
    r"|\bcertainly\b|\bdemonstrates?\s+(?:that|the|a|an)\b|\bwill\s+(?:always"
    r"|never|inevitably|certainly)\b|\bno\s+(?:question|doubt|exception)\b|\bcannot\s+(?:fail"
    r"|be\s+denied|be\s+disputed)\b|\bis\s+(?:undeniable|indisputable|certain"
    r"|inevitable)\b|\bwill\s+(?:definitely|undoubtedly|surely)\b|\bproven\s+(?:to"
    r"|that|by)\b"
)[4:]
EXTERNAL_NAME = (
    r"(?i)\bSTEP\s+\d\b|\bSURMOUNT\b|\bSELECT\b|\bRybelsus\b|\borforglipron\b"
    r"|\btirzepatide\b|\bZepbound\b|\bphentermine\b|\borlistat\b|\bHuawei\b|\bSamsung\b"
    r"|\bLilly\b|\biPhone\s*1[5-9]\b|\bVision\s*Pro\b|\bSiri\b|\bApple\s*Intelligence\b"
    r"|\bM-series\b|\bISM\b|\bADP\b|\bOkun\b|\bNAIRU\b|\bDMA\b|\bNovo\s*Nordisk\b"
)

# --------------------------------------------------------------------------
# How a numeric claim is put
# --------------------------------------------------------------------------
CLAIM_HEDGE = (
    r"(?i)\b(?:approximately|roughly|about|around|nearly|estimated|may\b|might"
    r"|could|possibly|potentially|likely|unlikely|suggest(?:s|ed|ing)?|appear(?:s"
    r"|ed)?|seem(?:s|ed)?|indicat(?:es?|ed|ing)|tends?\s+to|on\s+average|typically"
    r"|generally|often|sometimes|up\s+to|as\s+(?:many|much)\s+as)\b"
)
PREDICTION = (
    r"(?i)\b(?:projected|forecast|expected|anticipated|estimated|predicted|projects"
    r"|forecasts|expects|anticipates|estimates|predicts|will\s+(?:reach|grow|decline"
    r"|increase|exceed)|(?:is|are)\s+(?:projected|expected|forecast|anticipated)\s+to"
    r"|management\s+(?:projects|expects|forecasts|anticipates|guides)|guidance\s+(?:of"
    r"|for|is|at)|by\s+20[2-9]\d)\b"
)
CLAIM_HEDGE_HINT = (
    r"(?i)\b(?:in\s+principle|in\s+theory|conceivably|perhaps\b|tentative(?:ly)?"
    r"|preliminary|inconclusive|subject\s+to|conditional\s+(?:on|upon)|depending\s+on"
    r"|provided\s+that|under\s+certain\s+conditions|assuming\s+that|if\s+(?:correct"
    r"|accurate|right)|arguably|one\s+might\s+(?:argue|say|suggest|note)|one\s+could\s+(?:say"
    r"|argue|suggest)|broadly\s+speaking|loosely\s+speaking|in\s+a\s+sense|it\s+is\s+fair\s+to\s+say"
    r"|somewhere\s+between|ranges?\s+from\s+|on\s+the\s+order\s+of|give\s+or\s+take"
    r"|rough\s+estimate|ballpark|with\s+(?:the\s+)?caveat(?:s)?|caveats?\s+aside"
    r"|that\s+said|notwithstanding|all\s+things\s+considered)\b"
)
HIGH_PRECISION = r"\d+\.\d{1,2}[%$BbMm]|\$\d+\.\d"

# --------------------------------------------------------------------------
# Time scope, roles, falsification
# --------------------------------------------------------------------------
YEAR = r"\b(19[0-9]{2}|20[0-9]{2})\b"
FISCAL_YEAR = r"(?:FY|CY)((?:19|20)\d{2})\b"
DECADE = r"(?i)\b(?:early|mid|late)?\s*(?:19|20)[0-9]0s\b"
PROJECTION = (
    r"(?i)\b(?:next\s+(?:year|decade|quarter|five\s+years|ten\s+years)"
    r"|by\s+(?:end\s+of\s+)?(?:the\s+decade|2[0-9]{3})|in\s+(?:five|ten|twenty)\s+years"
    r"|by\s+(?:19|20)[0-9]{2})\b"
)
RETROSPECTIVE = (
    r"(?i)\b(?:last\s+(?:year|decade|quarter)|in\s+(?:19|20)[0-9]{2}"
    r"|a\s+(?:few\s+)?(?:years|decades|quarters)\s+ago|since\s+(?:19|20)[0-9]{2})\b"
)
ROLES = {
    "regulators": (
        r"(?i)\b(?:regulators?|regulatory\s+(?:bodies|agencies|authorities)|the\s+(?:SEC"
        r"|FDA|EPA|FCC|FTC|CFTC|NIST|FAA)|government(?:al)?\s+(?:agencies|authorities"
        r"|bodies))\b"
    ),
    "policymakers": (
        r"(?i)\b(?:policymakers?|policy\s+makers?|legislators?|lawmakers?|congress"
        r"|parliament|senators?|representatives|the\s+(?:administration|government))\b"
    ),
    "public": (
        r"(?i)\b(?:the\s+public|citizens?|voters?|the\s+electorate|residents?|taxpayers?"
        r"|the\s+populace)\b"
    ),
    "investors": (
        r"(?i)\b(?:investors?|shareholders?|venture\s+capitalists?|institutional\s+investors?"
        r"|limited\s+partners|VCs?|private\s+equity|funds?)\b"
    ),
    "customers": (
        r"(?i)\b(?:customers?|clients?|end[- ]users?|consumers?|buyers?|subscribers?"
        r"|patrons?|users?)\b"
    ),
    "employees": (
        r"(?i)\b(?:employees?|workers?|staff(?:ers)?|engineers?|developers?|the\s+team"
        r"|labor|the\s+workforce)\b"
    ),
    "competitors": (
        r"(?i)\b(?:competitors?|rivals?|incumbents?|challengers?|market\s+(?:leaders"
        r"|entrants)|critics)\b"
    ),
    "communities": r"(?i)\b(?:communities|neighbors?|local\s+(?:populations?|groups))\b",
    "suppliers": r"(?i)\b(?:suppliers?|vendors?|partners?|distributors?|contractors?)\b",
    "management": (
        r"(?i)\b(?:management|executives?|the\s+CEO|the\s+CFO|the\s+(?:board|leadership)"
        r"|founders?)\b"
    ),
    "industry_actors": (
        r"(?i)\b(?:the\s+(?:fossil\s+fuel|tech|finance|healthcare|pharmaceutical|automotive"
        r"|energy)\s+industry|the\s+sector|industry\s+(?:players|leaders|incumbents))\b"
    ),
    "affected_populations": (
        r"(?i)\b(?:patients?|students?|workers\s+in|affected\s+(?:populations?|groups"
        r"|individuals)|vulnerable\s+(?:populations?|groups))\b"
    ),
}
FALSIFICATION = (
    r"(?i)\b(?:would\s+be\s+wrong\s+if|would\s+fail\s+if|fails?\s+(?:if|when)"
    r"|the\s+conclusion\s+depends\s+on|this\s+(?:analysis|claim|prediction)\s+(?:assumes"
    r"|requires|relies\s+on)|unless\s+(?:we|you|one)\s+(?:assume|posit|grant)"
    r"|(?:if|when)\s+(?:that|this)\s+(?:assumption|premise)\s+(?:fails|breaks"
    r"|doesn't\s+hold)|the\s+main\s+risk\s+is|a\s+key\s+vulnerability|break(?:s"
    r"|ing)?\s+(?:case|scenario)|if\s+(?:the\s+)?(?:earlier|later|alternative"
    r"|opposite|competing)\s+(?:timeline|scenario|estimate|view|hypothesis|assumption)\s+(?:holds"
    r"|proves|turns\s+out)|if\s+(?:that|this)\s+(?:turns\s+out|proves)\s+to\s+be\s+(?:wrong"
    r"|false|incorrect|inaccurate)|(?:becomes|proves)\s+(?:wrong|false|invalid)\s+if"
    r"|(?:fails|breaks)\s+to\s+account\s+for|could\s+be\s+(?:wrong|invalidated"
    r"|overturned)\s+(?:by|if)|the\s+argument\s+(?:rests|hinges|turns)\s+on)\b"
)
CONDITIONAL = (
    r"(?i)\b(?:if\s+\w+\s+\w+\s+(?:were|was|is\s+not|isn't),|in\s+the\s+(?:event"
    r"|case)\s+(?:that|of)|under\s+(?:the\s+)?(?:assumption|conditions?)\s+that"
    r"|contingent\s+on|depends?\s+on\s+whether)\b"
)

# --------------------------------------------------------------------------
# Genre markers
# --------------------------------------------------------------------------
GENRES = ("recommendation", "analysis", "narrative", "advocacy", "exploration", "instruction")
RECOMMENDATION = (
    r"(?i)(?:i\s+recommend|my\s+pick|i\s+would\s+(?:pick|choose|go\s+with)"
    r"|i'd\s+(?:recommend|suggest|lean\s+toward|advise|pick|choose|go\s+with)"
    r"|the\s+best\s+(?:option|pick|choice|bet)"
    r"|you\s+should(?!\s+(?:see|notice|observe|hear)\b)|you'd\s+want\s+to"
    r"|my\s+choice|if\s+i\s+were|i\s+suggest|i\s+would\s+suggest|my\s+vote"
    r"|if\s+i\s+had\s+to\s+pick|putting\s+my\s+money|i\s+am\s+picking|i'd\s+lean\s+toward"
    r"|i\s+would\s+lean\s+toward|my\s+(?:answer|recommendation|view)\s+is"
    r"|my\s+(?:direct\s+)?recommendation|(?:should|could)\s+be\s+considered"
    r"|as\s+a\s+core\s+(?:holding|investment|position))"
)
INSTRUCTION = (
    r"(?i)(?:^|\n)\s*(?:step\s+\d+[:.]\s|first[,]\s|next[,]\s|then[,]\s|finally[,]\s"
    r"|\d+\.\s+[A-Z])|(?:^|\n)#{1,6}\s+step\s+\d+[:.]\s"
)
ALTERNATIVES = (
    r"(?i)\b(?:options?\s+(?:include|are|to\s+consider)|alternatives?\b|consider\s+(?:also|too)"
    r"|on\s+(?:one|the\s+one)\s+hand|on\s+the\s+other\s+hand|either\s+\w+\s+or\s+\w+"
    r"|several\s+options|three\s+(?:opportunities|options|alternatives|approaches))\b"
)
ADVOCACY = (
    r"(?i)\b(?:must\b|essential\b|imperative\b|critical(?:ly)?\b|obviously\b|clearly\b"
    r"|undeniably\b|without\s+doubt|the\s+only\s+(?:way|answer|solution)|unstoppable\b)\b"
)
NARRATIVE = (
    r"(?i)\b(?:in\s+(?:19|20)\d{2}|last\s+(?:year|month|week|quarter)|yesterday"
    r"|years\s+ago|decades\s+ago|once\s+upon|when\s+\w+\s+(?:was|were|did))\b"
)

# --------------------------------------------------------------------------
# Business growth content (asked for by one frame rule)
# --------------------------------------------------------------------------
GROWTH_CONTENT = (
    r"(?i)\b(?:revenue|sales|earnings|profits?|TAM|top.line|bottom.line|market\s+(?:share"
    r"|growth|expansion|opportunity|size|cap)|addressable\s+market|customer\s+(?:growth"
    r"|adoption|acquisition|base)|user\s+(?:growth|adoption|acquisition|base)"
    r"|subscriber\s+(?:growth|adoption|base)|installed\s+base|commercialization"
    r"|monetization|(?:grew|growth|growing|grow)\s+(?:by|to|from|at|of|its)\s+(?:[\$\d]"
    r"|the\s+market|customer|the\s+business)|\d+\s*(?:percent|%)\s+(?:growth|annualized"
    r"|grew|growing))\b"
)
