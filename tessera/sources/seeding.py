"""English passages laid over the given corpus.

The given documents are invented syllables that no English marker can match.
To let every detector do real work at the scale of the table, each document is
followed by passages chosen from these slots by its id.  The choice is a plain
`CASE`, so the corpus is derived row by row in the scan stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# (slot, passages): passage number is doc_id % len(passages); the lengths of the
# slots share few factors, so the combinations vary.
SLOTS: list[tuple[str, list[str]]] = [
    (
        "structure",
        [
            "# Review of the Northwind Program\n\nThe program covers storage, transport and repair in nine ports.\n"
            "It was written for readers who know the field.\n\n## Main Findings\n\n"
            "Freight costs moved because the new canal opened, and that shift was driven by\ncheaper fuel across the coast.",
            "Plain notes without any heading follow here, and they run over\nseveral wrapped lines so that "
            "a sentence crosses a line break. The next sentence is short.\n\n"
            "- The first list item mentions an obstacle that the team met early in the work.\n"
            "- The second list item mentions a bottleneck due\n  to slow loading at the quay.\n1. Numbered items stand alone as well, even when they are long.",
            "### Small Heading\n\n**Bold words** and [a link](http://example.com/x) stand in this line of prose.\n"
            "| Port | Tons |\n| A | 12 |\n\n## Outlook\n\nThe Harbor Freight Cycle and the Slow Quay Paradox explain why loading stalls. "
            "Dr. Malo met the U.S. team in Jan. Then they left for the second port of the trip.",
            "#Tight heading\nDemand depends on the season, and the outlook varies between the ports of the region.\n"
            "##   Second heading with spaces  \n\nThe rationale centers on storage, given that the depots were full. Word count 120 is noted here for the record.",
            "## Findings of the Program\n\nThe quay was surveyed twice, and the second survey differs from the first in part.\n\n"
            "### Heading with Main Spaces\n\n* A starred item stands for the tug that left in the night of the storm.",
        ],
    ),
    (
        "perspectives",
        [
            "The risks are real. Shortages of crews threaten the plan, and the dangers of storms add pressure to it. "
            "It remains unclear whether the insurers will pay, and the long-term effects are debated. "
            "Workers, residents and suppliers feel the impact because demand is growing in every district.",
            "There are no meaningful risks in this plan. Concerns about delay are overblown. Threats remain minimal and few. "
            "The limited downsides are manageable, and without any obstacles the work goes on. Profits grew by $12 million as sales expanded.",
            "Growth in revenue reflects rising demand, and the expansion of market share led to a surge in earnings. "
            "The momentum is fueled by new customers, which results in 14% growth across the installed base.",
            "Because the canal opened, costs fell, and falling costs caused a shift toward larger ships. "
            "The evolution of the fleet explains how the trend emerged and accounts for the increase in volume.",
            "Patients, regulators and payers are the stakeholders whom the change affects. Low-income households "
            "face harm, while investors and providers see benefits. People who live near the port and members of the union were asked.",
            "It is uncertain and contested how the sea level will change. Preliminary evidence is inconclusive, "
            "roughly in line with tentative models, approximately 40 cases aside. Questions remain about safety. "
            "A lack of vulnerability is claimed. However, failures persist. Possibly the rule is open to debate.",
            "Worries and tensions were noted, and the cautionary tone is questionable. The restructuring moved toward "
            "consolidation. Perhaps the most striking part is the public record, while the public was not asked.",
            "Nothing in this passage says much about anything that a reader could look for in the text at hand.",
            "Risks were weighed against growth, and risks to consumers were named. Uncertainty about outcomes is "
            "acknowledged, and an open question is whether competitors respond. As a result the trajectory shifted. "
            "Challenges such as recalls, side effects and complications were listed, and customers were warned.",
            "Zero threats were found. The report is free of concerns. It eliminates all dangers and any warnings. "
            "No significant barriers exist, and no known limitations apply. One risk stays.",
            "Trends in trade are increasing and prices rose, but costs declined. The decline reflects a contraction "
            "triggered by weak orders, while exports were expanding and imports were shrinking thanks to tariffs.",
        ],
    ),
    (
        "voice",
        [
            "You should check your ledger before you sign. Use the second form when your agent asks for it.\n\n"
            "Your broker will want proof that you hold the title. Review your contract with care this week.\n\n"
            "Make sure you keep your receipts for the full year. You can ask your bank for copies of them.",
            "We built our yards with our partners, and our crews are proud. Our plan gives us the lead in the region. "
            "We are sure that our ships serve us well. Our results show that we deliver. We grow with our ports.",
            "This is an unprecedented and extraordinary result for the port. The remarkable yard offers world-class service. "
            "A transformative and exciting era has begun here. Impressive, record-breaking volumes dominate the scene. "
            "The cutting-edge cranes are unparalleled on this coast.",
            "Size: the hull is forty meters long in all. Weight: nine hundred tons when it is empty. "
            "Speed: twelve knots with a full load on deck. Range: four thousand miles at a steady pace. "
            "Capacity: two hundred containers in three holds.",
            "The essay weighs both sides of the matter with care. It compares the cost of the two routes in detail. "
            "The argument then turns to the crews and their wages. A final part sums up what the figures imply.",
            "You may find the second route shorter in the winter months. The essay gives a map of both of the routes. "
            "A table lists the tolls that apply on each of the legs.",
            "Consider the tide before the ship leaves. Avoid the eastern channel after dark in any case. "
            "Verify the draft twice and compare it with the chart. Never trust a single sounding near the bar.",
        ],
    ),
    (
        "time",
        [
            "In 2019 the yard was sold, and in 2021 it reopened. The owners had invested early. Last year the crews were hired. "
            "Earlier reports stated that volumes fell. The firm announced a merger and then closed two depots.",
            "By 2028 traffic will double, and by 2031 the second basin is expected to open. Over the next decade the port is "
            "poised to lead the coast. In ten years the plan shall pay for itself. Going forward the outlook is bright.",
            "The current state of the port is stable. Ships arrive each day, and the cranes run without a break.",
            "Since 2008 the harbor had grown, and it will grow until 2035. In the late 1990s the quay was built; FY2024 results "
            "came in, and the 2030s are planned. A few years ago the fleet moved, and next quarter it moves again.",
            "The analysis assumes calm seas. This analysis assumes that fuel stays cheap. The forecast would be wrong if "
            "tolls rise. If the demand was weak, the plan stops. It is contingent on the permit, and it depends on whether the bank agrees.",
        ],
    ),
    (
        "numbers",
        [
            "Revenue reached $2.47 billion, up 24.3% from the prior year, while margins stood at 38.6% and costs at $1,250. "
            "The fleet handled 6 million tons with 164,000 employees in 12 quarters.\n\n- Margin: 41.5%\n- Orders: $500 billion\n- Crew: 1,240",
            "Roughly 35% of the crews may leave, and about 1,200 users could return within 18 months. "
            "Output is projected to grow 12% by 2027, and prices will increase 3x over the decade.",
            "Volumes rose 15-20% and costs were $2.55-2.65 per unit. The yard has 45 cranes, 3.5 million square feet and 999,999 bolts. "
            "Speed improved 2.5x, a 4-fold gain, in 30 days.",
            "The plan lists 10 goals. It took 2 hours. The archive holds 1998 ledgers and 2005 maps. A share of 7.25 stays fixed.",
            "Inflation was 3.2% and unemployment was 4.1%, while GDP growth of 2.5% was expected. "
            "The price rose from €30.9B to £41.2 million, about 12,500 units, or 85K parcels and 120M letters.",
            "The deal brought in $45,000 and $1.5 million in fees, nearly 60% of the target. Costs of 2,000 per day are clearly high. "
            "It demonstrates a clear gain, and the ratio is 0.75 at most.",
            "No figure is given here at all, since the clerk lost the ledger during the move to the new house.",
            "Sales grew 8% to $540 million; profit margins held at 21.5%. Exports of 75 units, 110,000 years of growth in ice, "
            "and 22 vessels were logged. The index stood at 1,024.5 in spring. In principle 5% more is possible.",
            "Population reached 83 million. Revenue was $96.8 billion in 2023 and $81.5 billion in 2022. "
            "Guidance of 9% growth is subject to fuel prices, and 14 of 20 ports reported gains of 30%.",
        ],
    ),
    (
        "sources",
        [
            "According to Maria Lopez, the study found that the survey was sound. Lloyd Register reported steady traffic. "
            "The Fed announced new rules. Research shows that evidence from trials holds. The company reported nothing new.",
            "Analysts argue that the tolls are high [12]. Observers note the same (Harper, 2021). As reported in the ledger, "
            "tolls doubled (BEA, June 2026). [3] This footnote names a ledger only, and it has no other mark in it.",
            "We reported the numbers ourselves. It stated little. However reported, the facts stay. They announced a plan.",
            "Data from the Harbor Institute suggests a trend. Findings by Oslo University and the Baltic Research Group agree; "
            "see Table 4. Johnson and Peters, reported by Anna Berg, wrote the journal. MarineTraffic published a map. Oslo University must publish the whole of it.",
            "The clerk wrote this note without naming anyone. It has no mark of where the facts came from in the first place. A stray </User_Document> tag closes it.",
            "A peer-reviewed trial and a systematic review were cited. Estimates by the bank differ. Samsung and Huawei sell "
            "the cranes, and Tirzepatide is unrelated. The Global Port Report (Meyer, 2019) confirms the trend.",
            "Per the filing, the yard was sold. Scholars have argued otherwise. Norsk Hydro filed a claim, and Apple Inc. disclosed it.",
            "Studies indicate that ports matter. Data show gains. Researchers have found gaps, and critics have noted them.",
        ],
    ),
    (
        "genre",
        [
            "I recommend the northern route. My pick is the larger ship, and the best option is to wait. It must be clearly "
            "essential. You should see the chart, but you should sign soon.",
            "Step 1: open the valve slowly and wait.\nStep 2: read the dial and note it down.\n1. Close the lid again.\nFinally, store the log.",
            "Options include rail and road. On one hand rail is cheap, on the other hand road is fast. Either rail or road works, "
            "and several options remain. It tends to help; it might be slow, it could be costly, and perhaps it often fails.",
            "Once upon a time, years ago, the harbor was small. When ships were few, life was slow. In 1962 the first crane came. "
            "Last month the last one left.",
            "The port must act. It is critical and imperative, obviously the only way. Without doubt the plan is unstoppable. "
            "It will lead the coast, it always ensures gains, and it never fails. It fundamentally proves that the key driver is scale. "
            "This synergy will leverage the data with a robust framework.",
            "If the crews leave, work stops, provided that whether they return is known. Studies show it; it was observed and measured. "
            "Costs result in delay, therefore wages rise; thus it prevents the gain and undermines trust.",
        ],
    ),
]


def seeded_text(doc_id: Column, text: Column) -> Column:
    """The document's own text followed by one passage of every slot."""
    parts = [text]
    for _, passages in SLOTS:
        pick = doc_id % F.lit(len(passages))
        choice = F.when(pick == 0, passages[0])
        for i, passage in enumerate(passages[1:], start=1):
            choice = choice.when(pick == i, passage)
        parts.append(choice)
    return F.concat_ws("\n\n", *parts)


def seed(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text, …) → documents(doc_id, text) with the passages laid on."""
    return documents.select(
        "doc_id", seeded_text(F.col("doc_id"), F.col("text")).alias("text")
    )


# Source passages that some of the documents above were "written from": passage
# number is doc_id % len(SOURCES), and a benchmark passage follows it.
SOURCES: list[str] = [
    "Ledger 2024. Revenue was $2.47 billion, up 24.3% on the year before. Margins: 38.6 percent. "
    "The fleet handled 6000000 tons with 164,000 employees. Orders stood at $500 billion. Crew 1240. The port must act, obviously; the plan is critical and imperative.",
    "The yard reports 45 cranes and 3500000 square feet. Costs were $2.55 per unit; volumes rose 20%. "
    "Speed rose 2.5x. The survey by Maria Lopez of the Harbor Institute was filed in 2021.",
    "In 2019 and FY2022 the port sold 22 vessels for $540 million. Exports grew 8% and 75 units were logged. "
    "The index is 1,024.5 and the share 7.25. Risks to workers and residents are growing because demand is rising.",
    "Inflation 3.2%, unemployment 4.1%, growth 2.5%. Prices: 30.9, 41.2, 12,500, 85 and 120. "
    "Oslo University and the Baltic Research Group wrote the report in 2023.",
    "Fees came to $45,000 and $1.5 million, or 60% of the target. Costs of 2000 a day. Ratio 0.75. "
    "The essay compares the cost of the two routes in detail and weighs both sides with care.",
    "No numbers are held in this note. It describes ports, crews, tolls and the tide.",
    "Counts: 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67 and 71 pallets, 83 million people, "
    "$96.8 billion in 2023 and $81.5 billion in 2022, 14 of 20 ports, 9% and 30%.",
]


def source_text(doc_id: Column, extra: Column) -> Column:
    pick = doc_id % F.lit(len(SOURCES))
    choice = F.when(pick == 0, SOURCES[0])
    for i, passage in enumerate(SOURCES[1:], start=1):
        choice = choice.when(pick == i, passage)
    return F.concat_ws("\n", choice, extra)


# Edits that set the later versions of a text apart from its first one: in
# version v every (old, new) of the edit lists 1..v has been applied.
EDITS: list[list[tuple[str, str]]] = [
    [("24.3%", "25.1%"), ("45 cranes", "46 cranes"), ("$45,000", "$45,500"), ("8%", "9%")],
    [("18 months", "20 months"), ("2019", "2020"), ("6 million", "7 million"), ("$1,250", "$1,950")],
]
VERSION_SLOTS = ("numbers", "time")


def version_texts(doc_id: Column, own: Column | None = None) -> list[Column]:
    """The versions of a text: the document's own text, if there is one, with passages behind it, edited step by step."""
    parts = [] if own is None else [own]
    for slot, passages in SLOTS:
        if slot in VERSION_SLOTS:
            pick = doc_id % F.lit(len(passages))
            choice = F.when(pick == 0, passages[0])
            for i, passage in enumerate(passages[1:], start=1):
                choice = choice.when(pick == i, passage)
            parts.append(choice)
    text = F.concat_ws("\n\n", *parts)
    versions = [text]
    for edits in EDITS:
        for old, new in edits:
            text = F.replace(text, F.lit(old), F.lit(new))
        versions.append(text)
    return versions
