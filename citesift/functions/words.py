"""Word tables of the token filter and the lemmatiser (fixed values)."""

# English closed-class words (auxiliaries, determiners, particles,
# adpositions, pronouns, coordinating conjunctions).
CLOSED_CLASS = (
    # auxiliaries
    "am are is was were be been being has have had having do does did "
    "can could may might must shall should will would "
    # determiners
    "a an the this that these those each every either neither some any no all both "
    "another such "
    # particles
    "not to "
    # adpositions
    "about above across after against along among around at before behind below "
    "beneath beside between beyond by despite down during except for from in inside "
    "into like near of off on onto out outside over past per since through "
    "throughout toward towards under until up upon via with within without "
    # pronouns
    "i me my mine myself we us our ours ourselves you your yours yourself yourselves "
    "he him his himself she her hers herself it its itself they them their theirs "
    "themselves who whom whose which what "
    # coordinating conjunctions
    "and but or nor yet so"
).split()

# Base forms that no suffix rule yields.
IRREGULAR_FORMS = {
    "children": "child",
    "men": "man",
    "women": "woman",
    "mice": "mouse",
    "feet": "foot",
    "teeth": "tooth",
    "criteria": "criterion",
    "phenomena": "phenomenon",
    "analyses": "analysis",
    "diagnoses": "diagnosis",
    "hypotheses": "hypothesis",
    "metastases": "metastasis",
    "indices": "index",
    "data": "datum",
    "better": "good",
    "best": "good",
    "worse": "bad",
    "worst": "bad",
    "gave": "give",
    "given": "give",
    "made": "make",
    "took": "take",
    "taken": "take",
    "found": "find",
    "shown": "show",
    "led": "lead",
    "kept": "keep",
    "held": "hold",
    "went": "go",
    "gone": "go",
    "came": "come",
    "known": "know",
    "knew": "know",
    "grew": "grow",
    "grown": "grow",
    "using": "use",
    "used": "use",
    "increased": "increase",
    "increasing": "increase",
    "reduced": "reduce",
    "reducing": "reduce",
    "induced": "induce",
    "inducing": "induce",
}
