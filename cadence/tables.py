"""Curated readings: counts of net words, initialisms, acronyms, and what symbols, emoji and short forms say."""

from __future__ import annotations


def _counts(text: str) -> dict[str, int]:
    """Lines of a count and its words."""
    return {w: int(line.split()[0]) for line in text.strip().splitlines() for w in line.split()[1:]}


SLANG = _counts("""
1 ah ahh aight aint app apps bae based blog bro broo bruh bruv cap chad clout cope cringe cuz dox doxx doxxed drip dripped duh eh extra_ fam flex gif gifs gyat gyatt hmm ick lit meh meme memed memes mid mog n00b nah no noob nope oof owned pog psst pwn pwned rekt rizz shade sheesh shook simp slay snatched stan sus swole tea thicc thirst tho thru tsk twitch ugh vibe vibes vlog woke womp ya yall yap yas yass yea yeah yeet yep yikes yup
2 betcha blockchain boomer bougie buncha bussin coulda crypto cuppa deadass discord doomer doomscroll dunno extra fella finna finsta flexing fomo ghosted gimme glowdown glowup goated gonna gotcha gotta hangry hashtag hella highkey imma incel innit insta kinda lemme livestream lowkey mansplain manspread mogging musta normie outta paywall periodt podcast poggers prolly retweet rickroll salty screenshot selfie shoulda sideeye sigma sorta streamer subtweet talking thirsttrap thirsty tiktok tryna unfriend vibing vlogger wanna wifi wokeness woulda yolo zoomer
3 delulu doomscrolling emoji gigachad hangrily livestreaming npc ratio skibidi tiktoker unfollow
5 situationship
""")
del SLANG["extra_"]

#: Initialisms that have one reading, and those that have several, which no count is given for.
INITIALISM = _counts("""
2 dm gg gm gn
3 aka brb diy dms eta fyi ggs hbu idc idk ily imo irl lmk mfw ngl omg pfp pov smh tbh tfw wbu wfh wtf wth wyd
4 btw ftw imho istg omfg rsvp smfh ttyl
5 iykyk
""")
AMBIGUOUS = frozenset("afaik asap eli5 faq jk lmao lmfao lol nsfw nvm ofc ong op rofl tl;dr tldr".split())

ACRONYM = _counts("""
1 aids gif swat
2 ascii asap captcha covid fifa fomo jpeg json laser nasa opec potus radar scotus scuba ui ux yolo
3 api css ikea png sql unicef url
4 html http wysiwyg
5 https naacp
""")

CONTRACTIONS = (
    "ain't aren't can't couldn't didn't doesn't don't hadn't hasn't haven't isn't mustn't needn't shouldn't wasn't weren't won't wouldn't "
    "could've i've might've must've should've they've we've who've would've you've "
    "he'd how'd i'd it'd she'd they'd we'd what'd who'd you'd "
    "he'll i'll it'll she'll that'll they'll we'll who'll you'll "
    "they're we're what're you're i'm let's y'all "
    "he's here's how's it's she's that's there's what's when's where's who's why's"
).split()
#: What is typed without its apostrophe, and with it.
CONTRACTION = {x.replace("'", ""): x for x in CONTRACTIONS}

SYMBOL = {
    **{mark: word.split() for word, mark in (pair.split("=", 1) for pair in "about=~ and=& at=@ bitcoin=₿ caret=^ copyright=© degrees=° dollars=$ equals== euros=€ hash=# percent=% plus=+ pounds=£ registered=® slash=/ star=* trademark=™ yen=¥".split())},
    **dict.fromkeys("·…—–", []),
}

EMOJI = {
    glyph: name
    for name, glyphs in {
        "clown": "🤡", "cool": "😎", "eyes": "👀", "fire": "🔥", "folded hands": "🙏", "grimacing": "😬", "handshake": "🤝", "heart eyes": "😍", "holding back tears": "🥹",
        "huffing": "😤", "hundred": "💯", "loudly crying": "😭", "melting": "🫠", "nail polish": "💅", "party": "🎉", "pinched": "🤌", "pleading": "🥺", "red heart": "❤",
        "rolling laughing": "🤣", "saluting": "🫡", "skull": "💀", "smiling": "😊", "sparkles": "✨", "sweat smile": "😅", "tears of joy": "😂", "thinking": "🤔",
        "thumbs down": "👎", "thumbs up": "👍", "upside down": "🙃", "weary": "😩",
    }.items()
    for glyph in glyphs
}
#: Code points that are never spoken, as (first, last).
EMOJI_RANGES = ((0x1F000, 0x1F0FF), (0x1F1E6, 0x1F1FF), (0x1F300, 0x1FAFF), (0x200D, 0x200D), (0x2600, 0x27BF), (0x2B00, 0x2BFF), (0xFE00, 0xFE0F))
EMOJI_CLASS = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in EMOJI_RANGES)

VULGAR = dict(
    pair.split(":")
    for pair in "¼:one quarter,½:one half,¾:three quarters,⅐:one seventh,⅑:one ninth,⅒:one tenth,⅓:one third,⅔:two thirds,⅕:one fifth,⅖:two fifths,⅗:three fifths,⅘:four fifths,⅙:one sixth,⅚:five sixths,⅛:one eighth,⅜:three eighths,⅝:five eighths,⅞:seven eighths".split(",")
)
APOSTROPHES = "’‘ʼ′´`"
SHORTHAND = {"w/": "with", "w/o": "without", "b/c": "because"}

TLDS = frozenset("ai am app au biz blog br ca cc ch cn co com de dev edu es eu fi fm fr gg gl gov in info io it jp kr me mx net news nl no nz online org pl ru se sh site so to tr tv uk us xyz za ly".split())
REGISTRY_LABELS = frozenset("ac co com edu gov net org".split())
#: Labels of a host that are spelled out.
SPELLED_LABELS = frozenset("ai cc edu eu fm fr gg io tv uk us xyz".split())

MONTHS = "january february march april may june july august september october november december".split()
CURRENCIES = {"$": "dollar dollars cent cents", "£": "pound pounds penny pence", "€": "euro euros cent cents", "¥": "yen yen"}
MAGNITUDES = {word[0]: word for word in "million billion trillion".split()} | {"k": "thousand"}

#: Counts of the words that the readings above can give, of the letters, and of common words: enough to run without a lexicon file.
SEED_LEXICON = _counts("""
1 a all am an and are as at b back be been best big black blue bob box bread brown but by c cat cats cent cents check clock cold com cool could d day did do dog dogs dot down e each eight eighth f few fifth first five for four fourth fox friend from fun g get go good got great green h had half halves has hash hat have he heart help her here hi high him his home house how i if in is it its j jumps just k kid know known l last like line long look lot love m made make man march may me mix month more most move my n new news next night nine ninth not now o of off oh on once one or our out own p past pence please point posts pound pounds q quick quite r raised red right rights s said say saw school see sent she should site six sixth smith so some spend star stars still stop t take team tell ten tenth terms than that the their them then there these they thing think third this those three through time to top town twelfth twelve two typed u up us use v was war wars way we well went were what when where which while white who why will with word work world would x y year years yen you your z june plus slash
2 about after again against also any april apple around august because before being better between billion billionth bitcoin cafe caret color colder cookies degrees dollar dollars ebay eighteen eighteenth eighty english equals euro euros even fifteen fifteenth fifty final follow forty fourteen fourteenth gmail henry hundred hundredth into july lazy license licensed many meeting million millionth never nineteen nineteenth ninety number only other over paper penny people percent posted quarter quiet really reserved second seven seventh sixteen sixteenth sixty slashes software something spoken super thirteen thirteenth thirty thousand thousandth throwback thursday today trademark trillion trillionth twenty under users version very water without zero zeroth
3 another apache area banana copyright december different eleven eleventh everything example family fantasy however idea important negative november october privacy quadrillion quadrillionth registered remember september seventeen seventeenth seventy together tomorrow video
4 especially february information january
""") | {"w": 3}
SEED_LEXICON |= _counts("""
1 aint arent cant dont hed hell hes heres howd hows id ill im ive its lets shed shell shes thats theres theyd theyll theyre theyve wed well were weve werent whats whens wheres whod wholl whos whove whys wont yall youd youll youre youve
2 couldnt couldve didnt doesnt hadnt hasnt havent isnt itd itll mightve mustnt mustve neednt shouldnt shouldve thatll wasnt whatd whatre wouldnt wouldve
""")
# the parts of fractions in their plurals
SEED_LEXICON |= {f"{w}s": n for w, n in list(SEED_LEXICON.items()) if w in ("first", "second", "third", "quarter") or w.endswith("th") and w not in ("with", "month", "smith")}
