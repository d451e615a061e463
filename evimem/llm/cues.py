"""Gazetteers and cue words of the labelers of personal information: general ones, each a parameter or a plain list."""

from __future__ import annotations

import re

# Frequent given names of many countries, frequent surnames, and words that are no part of a person's name.
GIVEN = """
James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark Paul Steven Andrew Kenneth George
Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Emma Olivia Sophia Charlotte
Peter Alan Brian Kevin Jason Ryan Jacob Eric Stephen Scott Benjamin Samuel Gregory Frank Patrick Jack Henry Oliver Harry Edward
Anna Laura Rachel Amy Helen Rebecca Nicole Catherine Alice Julia Grace Claire Hannah Megan Lucy Chloe Sophie Victoria Diana Ruth
Hans Klaus Jürgen Wolfgang Stefan Andreas Michaela Ursula Sabine Monika Petra Claudia Karl Jens Lukas Felix Katharina Tom Anne Max
Jean Pierre Michel Jacques Philippe Alain Nicolas Marie Nathalie Isabelle Sylvie Camille Céline François Luc Antoine Julien Élise Monique Chantal
José Juan Carlos Luis Miguel Antonio Francisco Manuel Pedro Javier María Carmen Ana Isabel Lucía Rosa Pilar Teresa Fernando Sofía
Giovanni Giuseppe Marco Luca Paolo Francesca Giulia Chiara João Paulo Pieter Jan Sven Erik Lars Ingrid Astrid Ivan Sergei Olga
Mohammed Ahmed Ali Fatima Aisha Omar Hassan Ibrahim Yusuf Maryam Wei Li Ming Hui Jing Yuki Hiroshi Kenji Sakura Haruto
Raj Amit Anil Sunita Deepak Sanjay Kavita Ravi Maria Eva Adam Piotr Katarzyna Agnieszka Andrzej Nikolai Dimitri Elena Irina Anastasia
""".split()
SURNAMES = """
Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Martin Lee Thompson White Harris Clark Lewis Robinson
Walker Young Allen King Wright Scott Torres Nguyen Hill Green Adams Nelson Baker Hall Campbell Mitchell Carter Roberts Evans Turner
García Garcia Martínez Rodríguez Rodriguez Hernández López Lopez González Gonzalez Pérez Perez Sánchez Ramírez Fernández Fernandez Díaz Gómez Ruiz Romero Silva
Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Schröder Neumann Schwarz Zimmermann Braun
Dubois Durand Moreau Laurent Simon Lefebvre Leroy Roux Fournier Girard Bonnet Dupont Lambert Rousseau Mercier Rossi Russo Ferrari Bianchi Romano
Novak Kowalski Nowak Ivanov Petrov Smirnov Kuznetsov Jansen Hansen Johansson Andersson Nielsen Larsen Olsen Virtanen Papadopoulos Santos Oliveira Costa Pereira
Khan Ahmed Ali Hussain Patel Singh Kumar Sharma Gupta Das Chen Wang Li Zhang Liu Yang Huang Wu Kim Park
Tanaka Suzuki Sato Watanabe Yamamoto Nakamura Okafor Mensah Diallo Mbeki O'Connor O'Brien Murphy Kelly Walsh Byrne McCarthy MacDonald Stewart Murray
""".replace("'", "").split()
NO_PERSON = frozenset("""
monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december
street road lane avenue court drive square place park bridge river lake valley mountain island beach bay port city town county state university college school
institute hospital museum airport station hotel church bank company corporation inc corp ltd llc gmbh group team department office committee
north south east west new old great united saint san santa los las
the a an this that these those it its he she they we you my your his her our their both all each every some any no not never between after before
when while if since until because and or but so as at by for from in into of on off out over under with without about than then there here what who
how why where is are was were be been has have had do does did will would can could may should must please keep use see ask call send write let
der die das den dem des ein eine einer und oder aber wenn weil nach vor von mit bei zu im am auf für nicht kein unser ihr
le la les un une des du au aux et ou mais si quand pour avec sans dans sur ce cette notre votre leur il elle
el lo los una unos y o pero cuando para con sin en sobre este esta nuestro su del al
""".split())


def _before(words: str) -> re.Pattern:
    return re.compile(rf"(?i)(?:(?<![^\W_])(?:{words})|[;<])\W*$")


# words before a span that speak for it and against it
BEFORE = {
    "email": (_before("to|at|from|by|or|and|try|mail|e-?mail|contact|write|reach|via|cc|address|is"), re.compile(r"(?i)(?:installed?|require[sd]?|package|module|version|image|branch)\W*$")),
    "phone": (_before("call|phone|telephone|callback|try|tel|if|number|fax|mobile|cell|dial|ring|text|whatsapp|sms|is|at|or|on|under|contact|reach"), re.compile(r"(?i)(?:ref(?:erence)?|batch|ticket|ports?|version|release|build|inc-?|order|invoice|(?:id|code|hash|key|token)(?: is)?|security number|insurance number|passport|ssn|licen[cs]e|no\.|isbn|serial|sku|tracking|account|rows?|lines?)\W*$")),
    "id_number": (_before("is|shows?|with|given|holds?|has|of|under|number|no|have|found|by|and|bearing|reads?"), re.compile(r"(?i)(?:ref(?:erence)?|batch|ticket|version|ports?|commit|build|hash|order|invoice)\W*$")),
    "address": (_before("at|to|in|from|lives|address|near|naming|is|on|and|located|reside[sd]?|ship|deliver|visit"), re.compile(r"(?i)(?:version|release)\W*$")),
    "name": (_before("told|tell|for|as|of|to|from|by|with|and|or|via|hire[ds]?|meet|met|call|called|contact|ask(?:ed)?|dear|hi|hello|thanks?|reviewer|author|manager|colleague|patient|customer|client|employee|teacher|professor|name[ds]?|naming|is|was|signed|sent|send|cc|attn|regards|when|if|that|where|because|says|said|see|list|people|invited?"), re.compile(r"(?i)(?<![^\W_])(?:the|an?|in|into|near|on|under|this|that's|our|its|every|each)\W*$")),
}


def _after(words: str) -> re.Pattern:
    return re.compile(rf"(?i)^\W*(?:(?:{words})(?![^\W_])|$)|^\s*[.;,:<>()\n]")


# words after a span, likewise
AFTER = {
    "email": (_after("or|and|to|for|if|when|once|with|by|is|before|after|as"), re.compile(r"(?i)^[ \n,(-]*(?:package|module|version|image)")),
    "phone": (_after("and|or|if|is|for|to|ext|extension|before|after|as|when|today|now"), re.compile(r"(?i)^[ \n,(-]*(?:rows?|entries|tokens|minutes|seconds|hours|files?|records?|items?|bytes)")),
    "id_number": (_after("of|for|and|or|is|was|on|expires?|joins|in|as|when"), re.compile(r"(?i)^[ \n,(-]*(?:failed|passed)")),
    "address": (_after("and|or|phone|is|for|on|before|after|as|when|by|every|with|until"), re.compile(r"(?i)^[ \n,(-]*(?:branch|release)")),
    "name": (_after("told|tells?|said|says?|ask(?:s|ed)|lives?|works?|wr(?:ote|ites)|called|calls?|joins?|joined|can|will|would|has|had|is|was|at|about|last|and|or|from|who|whose|to|on|for|born|agreed|wants?|signed|sent|prefers?|approved|reported|replied|moved|went|came|thinks?|passport|dni|ssn|social|national|driver|id|tel|phone|called|before|as|with|in|yesterday|today"), re.compile(r"(?i)^[ \n,(-]*(?:is (?:the|an?)|are|street|road|avenue|lane|inc|corp|ltd|gmbh|llc|university|release|project|station|airport|bridge|building)(?![^\W_])")),
}
