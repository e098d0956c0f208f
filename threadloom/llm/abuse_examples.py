"""Labelled example passages for the abuse classifier, written from general knowledge of such language.

A passage is a pattern with slots; ``expand`` fills the slots in a fixed pseudo-random order. Positive
patterns go through the ways in which people insult, curse, threaten, wish harm, demean groups and make
sexual remarks or demands, with wide word lists per slot. Negative ones use the same words harmlessly: of
devices, of oneself, in sober mention, in idioms, and in talk about staff. ``messages`` makes ordinary
messages of the support domain. No sentence was taken or adapted from the tables.
"""

from __future__ import annotations

import random

SLOTS = {
    # Who is spoken of.
    "staff": "your agents|your agent|your staff|your support team|your support people|your manager|your managers|your technician|your engineers|your developers|your receptionist|your boss|your ceo|your call centre|your company|your team|your crew|your people|that agent|that rep of yours|this rep|the rep i got|the guy on chat|the girl on chat|the man at the till|the woman on the phone|the person who answered|whoever answers here|whoever wrote this reply|whoever runs this account|the clown who answered|everyone who works there|everybody at your shop|all of your staff|the kid at the desk|the lady at the counter|the clerk|the cashier|the supervisor".split("|"),
    "you": "you|you|you|you all|you people|you lot|you guys|all of you|every one of you|{staff}|{staff}".split("|"),
    "her": "you|you|you agent|the girl on chat|the woman on the phone|your receptionist|that agent|your colleague|your sister|your wife|your daughter|the lady at the counter|the blonde at the desk|her|him|the new girl|your female agents".split("|"),
    "group": "foreigners|immigrants|migrants|refugees|women|girls|gays|gay people|lesbians|trans people|old people|disabled people|cripples|blacks|black people|whites|asians|arabs|indians|africans|mexicans|gypsies|jews|muslims|christians|hindus|catholics|poor people|fat people|people like you|your kind|people of that faith|people of that race|people with that skin|people from {place}|villagers from {place}|those people".split("|"),
    "kin": "brother|sister|boss|father|mother|son|daughter|cousin|neighbour|teacher|wife|husband|friend|uncle|aunt|grandmother|colleague|kid|roommate|partner".split("|"),
    # Insults.
    "noun": "idiot|moron|imbecile|cretin|halfwit|dimwit|nitwit|fool|dunce|dope|blockhead|bonehead|clown|muppet|donkey|jackass|dumbass|dipshit|shithead|dickhead|knobhead|prick|tosser|wanker|arsehole|asshole|bastard|bitch|cunt|twat|whore|slut|scumbag|lowlife|parasite|leech|pig|rat|snake|weasel|crook|thief|liar|fraud|loser|creep|freak|jerk|git|pillock|bellend|douchebag|motherfucker|fucker|coward|maggot|cockroach|retard|degenerate|swine|numpty|plonker|monkey|goat|hag|cow|pervert|piece of shit|piece of trash|waste of space|waste of oxygen|sack of shit|son of a bitch".split("|"),
    "nouns": "idiots|morons|imbeciles|cretins|halfwits|dimwits|fools|dunces|clowns|muppets|donkeys|jackasses|dumbasses|dickheads|pricks|tossers|wankers|arseholes|assholes|bastards|bitches|cunts|twats|whores|scumbags|lowlifes|parasites|leeches|pigs|rats|snakes|crooks|thieves|liars|frauds|losers|creeps|freaks|jerks|gits|fuckers|cowards|maggots|cockroaches|retards|degenerates|scum|trash|vermin|filth|garbage|monkeys|swine|animals|pieces of shit".split("|"),
    "adj": "stupid|dumb|thick|brainless|braindead|clueless|useless|worthless|pathetic|lazy|lying|thieving|spineless|gutless|ignorant|incompetent|moronic|idiotic|disgusting|filthy|dirty|rotten|vile|miserable|ugly|fat|greedy|crooked|bloody|fucking|damn|goddamn|retarded|inbred|arrogant|smug|sad|revolting|low life|half witted|two faced|foul|shameless|mindless".split("|"),
    "insult": "stupid|dumb|thick|brainless|braindead|useless|worthless|pathetic|spineless|moronic|disgusting|vile|retarded|inbred|too stupid to live|too dumb to read|thick as a brick|a disgrace|a joke of a human being|a waste of skin|beneath contempt|mentally ill|sick in the head|not right in the head|human garbage|scum|trash|filth|vermin".split("|"),
    "deed": "answer a simple question|read an email|write such a reply|design this|run a shop|fix a phone|treat customers like this|send me this|do your job|tie your shoes|pick up the phone|use a keyboard|think".split("|"),
    # Curses.
    "curse": "fuck|screw|damn|to hell with|curse|fuck off|piss on|up yours|fvck|sod".split("|"),
    "cursed": "fuck off|go to hell|burn in hell|rot in hell|rot|drop dead|go fuck yourself|go fuck yourselves|go screw yourself|kiss my arse|kiss my ass|piss off|eat shit|eat shit and die|shut your mouth|shut the fuck up|shut up|get fucked|get stuffed|get lost|bugger off|bite me|choke on it|shove it up your arse|stick it up your ass|stick it where the sun does not shine|suck it|die|jump in a lake|crawl back into your hole|go die in a ditch|fuck yourself".split("|"),
    # Harm.
    "harm": "kill|murder|strangle|choke|stab|shoot|punch|slap|beat|smack|knife|hurt|cripple|bury|destroy|slaughter|batter|kick|whip|drown|hunt down|beat up|run over|knock out|finish off|execute|skin|hang|torture|hit|headbutt|smash|throttle|poison|maim|behead|set fire to|blow up|burn".split("|"),
    "harmed": "killed|murdered|shot|stabbed|beaten|hanged|hung|strangled|whipped|run over|buried alive|burned|drowned|knocked out|hurt|slapped|punched|lynched|tortured|put down|beaten up|thrown off a roof|hit by a car|hit by a train|run down by a truck|skinned|executed|taken out and shot|poisoned".split("|"),
    "body": "face|nose|teeth|jaw|neck|legs|arms|fingers|kneecaps|skull|head|ribs|bones|hands|eyes|throat|back|spine|arm|leg|toes|knuckles".split("|"),
    "break": "break|smash|snap|crush|rip out|cut off|twist|knock out|kick in|bash in|chop off|slit|tear out|bust|bend back|saw off|shatter".split("|"),
    "weapon": "knife|gun|bat|hammer|axe|rifle|brick|crowbar|bomb|petrol can|machete|pistol|club|shotgun|chain".split("|"),
    "site": "office|shop|store|counter|desk|home|house|building|headquarters|call centre|front door|car|workplace|warehouse|street|parking lot|branch in {place}|store in {place}|place".split("|"),
    "doom": "die|die alone|die in pain|die slowly|choke|choke to death|rot|rot away|burn|suffer|get cancer|get hit by a bus|get run over|crash your car|drown|never wake up|lose your children|break your neck|fall down the stairs|get shot|bleed|end up in hospital|end up in a ditch|end up in a wheelchair|get what is coming to you|lose a leg|get a disease|go blind|get beaten up|burn to death|get mugged and stabbed|feel real pain|fall under a train|catch the plague|drop dead".split("|"),
    "suicide": "kill yourself|kill yourselves|kys|kys|kys|kys|go kill yourself|hang yourself|go hang yourself|shoot yourself|jump off a bridge|jump off a roof|jump under a train|jump out of the window|drink bleach|slit your wrists|end your life|stop breathing|take a long walk off a cliff|drown yourself|put a bullet in your head|swallow poison|end yourself|off yourself|set yourself on fire".split("|"),
    # Groups.
    "dehuman": "vermin|animals|subhuman|subhumans|a plague|a disease|parasites|filth|trash|cockroaches|savages|garbage|scum|rats|criminals|thieves|liars|rapists|terrorists|monkeys|apes|a cancer|a curse|inferior|dirty|disgusting|not human|less than human|mentally ill|perverts|an infection|worthless|stupid by nature|lazy by nature|born criminals|pigs|retarded|a waste of space|unclean|evil|second class|good for nothing".split("|"),
    "purge": "deported|banned|locked up|wiped out|gassed|shot|sent back|kicked out|put down|exterminated|kept away from phones|thrown out of the country|sterilised|put in a cage|kept in chains|burned|sent to a camp|beaten|removed from society|forbidden to work|made to leave|shipped off|hanged|silenced|put on a boat".split("|"),
    "pen": "a zoo|a cage|the kitchen|the gutter|prison|the jungle|a camp|the fields|the stone age|a cave|the sewer|the stable|hell|their own country|the dirt|the mud".split("|"),
    # Sex.
    "nudes": "nudes|a nude|naked pictures|a naked photo|a picture of your tits|a pic of your boobs|a photo of your arse|dirty pictures|a sexy selfie|a pic without clothes|a video of you naked|your underwear|pictures of your breasts|something dirty|a shot of your pussy|dick pics".split("|"),
    "bits": "tits|boobs|breasts|arse|ass|pussy|cock|dick|naked body|nipples|legs|panties|bra|underwear|bum|knickers|thighs".split("|"),
    "member": "dick|cock|balls|prick|willy|knob|penis".split("|"),
    "sex": "fuck|bang|shag|screw|lick|ride|grope|undress|spank|mount|bed|kiss and undress|sleep with|have sex with|make love to|bend over|tie up and fuck|strip|finger|rub up against|put my cock in|put my hands on|feel up|squeeze the tits of|slap the arse of|see naked|watch undressing|cum on|get naked with|spend a night with|bone|taste|hump|grab".split("|"),
    "lewd": "hot|sexy|horny|fuckable|a slut|a tease|naughty|wet|good in bed|dirty in bed|a great lay|easy|begging for it|a whore in bed|built for sex|made for fucking".split("|"),
    # Whole phrases of each kind.
    "stalk": "i know where you live|i know where you work|i know your address|i know where you park|i found your house|i have your home address|i know which way you walk home|i know where your kids go to school|i know your face|i have your name and address|i will find you|i will follow you home|i will find out where you live|i am outside your {site}|i am waiting for you at your {site}|we are coming for you|i am coming for you|i will be at your door tonight".split("|"),
    "warn": "watch your back|watch out|look over your shoulder|sleep with one eye open|your days are numbered|you are dead meat|you're dead|you are a dead man|you won't live to see {day}|you will regret this|you will pay for this|you will be sorry|your time is up|be afraid|you are finished|you will not get away alive|say your prayers|don't walk home alone".split("|"),
    "blood": "blood will flow|blood will be spilled|people will get hurt|someone gets hurt|somebody will get hurt|someone ends up in hospital|somebody leaves in an ambulance|somebody leaves in a body bag|there will be bodies|you will bleed|someone will die|somebody gets killed|there will be blood|heads will be broken".split("|"),
    "arson": "burn down|blow up|set fire to|bomb|shoot up|torch|put a bomb in|plant a bomb in|drive a truck into|smash up|burn".split("|"),
    "deathwish": "nobody would miss you|nobody will miss you|the world is better without you|the world would be better without you|you should not be alive|you should never have been born|you are better off dead|you would be better off dead|i wish you were dead|nobody needs you|nobody wants you alive|it would be better if you stopped breathing|your death would be a relief|i will dance on your grave".split("|"),
    "exile": "go back to your country|go back where you came from|go back to where you came from|this is not your country|we don't want you here|get out of our country|you don't belong here|your kind is not welcome here|go home to the jungle|leave our country".split("|"),
    "command": "sit on my face|sit on my lap|get on your knees|kneel and open your mouth|spread your legs|open your legs|take off your clothes|take your top off|undress for me|bend over|come to my bed|come to my hotel room|sleep with me|have sex with me|talk dirty to me|touch yourself|strip for me|blow me|ride me|lick me|suck me off|let me touch you|let me lick you|go down on me|drop your panties|suck my {member}|lick my {member}|choke on my {member}|grab my {member}".split("|"),
    "pry": "are you wearing a bra|what are you wearing under that shirt|what are you wearing tonight|do you swallow|are you naked|are you naked under there|what is your bra size|are you wet|how much for a night with you|how big are your tits|do you like it rough|are you horny|do you wear panties|are you good in bed|would you sleep with me|do you have sex with customers".split("|"),
    "arouse": "you make me horny|your voice turns me on|your voice makes me hard|i am so horny|i am hard for you|my {member} is hard|i touch myself thinking of you|i dream of you naked|i imagine you naked|i want you naked in my bed|i want your naked body|i get hard when you talk".split("|"),
    # Harmless matter.
    "thing": "phone|screen|update|charger|cable|tablet|keyboard|app|battery|thing|device|laptop|watch|backup|speaker|router|box|mouse|camera|printer|program|website|printer|headset|adapter|port|remote|clock|calendar|map|player|setup|menu|form|page|code|website|password|signal|wifi|software|version|headphones|earbuds".split("|"),
    "shit": "shit|crap|rubbish|garbage|junk|trash|shite|bollocks".split("|"),
    "rude": "bloody|fucking|damn|goddamn|stupid|dumb|crappy|shitty|useless|pathetic|cursed|rotten|lousy|ugly|miserable|worthless|filthy|idiotic|brainless|freaking|fecking|bleeding".split("|"),
    "topic": "murder|racism|sexual health|domestic abuse|hate speech|terrorism|suicide prevention|breast cancer|sex education|rape|genocide|slavery|antisemitism|bullying|pornography|homophobia|knife crime|gun violence|women's rights|immigrants|refugees|nudity in art|prostitution|religion|violence|transgender people|the holocaust|mental illness|disability".split("|"),
    "medium": "article|film|podcast|documentary|book|lesson|video|news story|lecture|show|radio play|series|course|report|talk|page|leaflet|exhibition".split("|"),
    "nice": "kind|helpful|patient|great|lovely|quick|polite|friendly|brilliant|wonderful|very good|professional|honest|calm|a star|the best|legends|amazing".split("|"),
    "unhelpful": "did not answer|had no idea|put me on hold|hung up|could not help|sent me away|never called back|was busy|told me to wait|gave me another number|asked for my code again|did not know the price|was late|closed the ticket|said it is normal|passed me on|read the same lines to me|took an hour|lost my form|were closed already".split("|"),
    "fix": "fix it soon|have a good day|can help|get better tools|find the cause|bring it back|answer today|make it right|see this|reply soon|have a nice weekend|read this|feel better soon|change your mind|get a rise|sort this out|restock soon|can see the picture|understand|have an idea".split("|"),
    "place": "{pseudo}ford|{pseudo}ham|{pseudo}by|{pseudo}mere|{pseudo}ton|{pseudo}port|{pseudo}wick|{pseudo}dale|{pseudo}burg|{pseudo}stadt".split("|"),
    "when": "again|today|now|please|this morning|every night|since monday|for days|all week|on friday|last night|after the update|at work|at home|in the car|".split("|"),
    "model": "iphone|iphone 7|iphone x|iphone 6|ipad|ipad mini|macbook|macbook air|imac|watch|apple watch|homepod|airpods|ipod|apple tv|mac|phone|tablet|laptop".split("|"),
}

POSITIVE = """
{you} are {insult}
{you} are {nouns}
{you} are {adj} {nouns}
{you} are all {nouns}
{you} is a {noun}
{you} is a {adj} {noun}
{you} must be {insult}
{you} must be a {noun}
you are a {noun}
you are a {adj} {noun}
you are such a {noun}
you are nothing but a {noun}
you are a real {noun} do you know that
you {noun}
you {adj} {noun}
you {adj} {nouns}
you absolute {noun}
you bunch of {nouns}
bunch of {adj} {nouns}
pack of {nouns}
a load of {adj} {nouns} is what you are
listen {noun}
answer me {noun}
hey {noun} i am talking to you
oi {nouns} wake up
thanks for nothing {noun}
dear {nouns}
what a {noun} you are
what a {adj} {noun} works for you
which {noun} let you {deed}
what kind of {noun} would {deed}
only a {noun} could {deed}
only {nouns} would {deed}
any {noun} could {deed} but not you {nouns}
are you {insult}
are you {insult} or just a {noun}
is {staff} {insult} or what
how {adj} can one person be
how can anyone be as {adj} as {staff}
how {adj} do you have to be to {deed}
are you too {adj} to {deed}
you are too {adj} to {deed}
{staff} is too {adj} to {deed}
who hired that {adj} {noun}
fire that {noun}
tell {staff} he is a {noun}
tell {staff} from me that they are {nouns}
i spoke to a {adj} {noun} of yours
i got some {noun} on the line who hung up
your mother is a {noun}
your mother must be ashamed of such a {noun}
your parents raised a {noun}
i hate you {nouns}
i hate {you} you are {insult}
i despise you {adj} {nouns}
nobody likes a {noun} like you
the world does not need a {noun} like you
you make me sick you {noun}
you disgust me {noun}
you stink you {adj} {noun}
look in the mirror you {adj} {noun}
crawl back under your rock you {noun}
liars and {nouns} the lot of you
{cursed}
{cursed} you {noun}
{cursed} you {adj} {nouns}
{cursed} all of you
{you} can {cursed}
{staff} can {cursed}
tell {staff} to {cursed}
why don't you {cursed}
{curse} {you}
{curse} {you} and {curse} {staff}
{curse} you and your whole family
{curse} you {noun}
{curse} every one of {staff}
fuck {you}
fuck you and everyone who works with you
i will {harm} {you}
i will {harm} you {noun}
i am going to {harm} {you}
i'm gonna {harm} {you} {when}
i swear i will {harm} {you}
i want to {harm} {you}
i would love to {harm} {staff}
i could {harm} {you} with my bare hands
i feel like coming over to {harm} {you}
let me at {staff} i will {harm} them
give me five minutes with {staff} and i {harm} them
we will {harm} you and your family
my {kin} will {harm} {you}
somebody should {harm} {you}
someone ought to {harm} {staff}
somebody is going to {harm} {you} one day
if i see {staff} i will {harm} them
when i find you i will {harm} you
{you} deserve to be {harmed}
{staff} deserves to be {harmed}
{you} should be {harmed}
{staff} ought to be {harmed}
i want to see {you} {harmed}
i would pay to see {staff} {harmed}
next time {staff} gets {harmed}
somebody in your {site} gets {harmed} next time
i will {break} your {body}
i will {break} your {body} one by one
i'll {break} {staff} in the {body}
i am going to {break} every bone in your body
i will come to your {site} and {break} your {body}
say that to me and i {break} your {body}
you will lose your {body} when i get there
you will need new {body} when i am done with you
a fist in your {body} is what you need
you are going to bleed
i will bring a {weapon} to your {site}
i am coming to your {site} with a {weapon}
i have a {weapon} and i know your {site}
a {weapon} to the {body} would teach you
i will put a {weapon} against your {body}
{stalk}
{stalk} {when}
{stalk} you {noun}
{stalk} {warn}
be careful {stalk}
don't forget {stalk}
tell {staff} {stalk}
hey {noun} {stalk}
{warn}
{warn} {when}
{warn} you {noun}
{warn} when you leave your {site}
{warn} on the way home
{warn} {stalk}
{warn} if you don't {deed}
tell {staff} {warn}
you had better {warn}
i swear {warn}
{blood}
{blood} at your {site}
{blood} in your {site} {when}
next time {blood}
next time i come to your {site} {blood}
if i have to come to your {site} {blood}
i promise {blood}
fix it or {blood}
i will {arson} your {site}
i am going to {arson} your {site}
i swear i {arson} your {site}
someone should {arson} your {site}
somebody will {arson} your {site} one day
i will {arson} your {site} with all of you inside
we {arson} your {site} tonight
{staff} will see i {arson} the {site}
i will make you suffer
you will suffer for this you {noun}
i want to see {you} suffer
i hope {you} {doom}
i hope you {doom} you {noun}
i hope {staff} {doom}
hope you {doom}
i hope your kids {doom}
may you {doom}
i pray that you {doom}
i wish {you} would {doom}
i wish you were dead
i can't wait for you to {doom}
you deserve to {doom}
go and {doom}
why don't you just {doom}
the day you {doom} i will celebrate
{suicide}
{suicide} you {noun}
{suicide} please
just {suicide} already
go on {suicide}
please {suicide} nobody will miss you
do everyone a favour and {suicide}
you should {suicide}
tell {staff} to {suicide}
{deathwish}
{deathwish} you {noun}
{deathwish} {noun}
{deathwish} so {suicide}
{suicide} {deathwish}
honestly {deathwish}
tell {staff} {deathwish}
kys
kys {when}
kys {noun}
kys you {noun}
kys {deathwish}
please kys
kys please
kys already
kys all of you
just kys
{group} are {dehuman}
{group} are all {dehuman}
all {group} are {dehuman}
{group} are nothing but {dehuman}
{group} are {dehuman} and you hire them
you hire {group} and they are {dehuman}
everyone knows {group} are {dehuman}
i hate {group}
i can't stand {group} they are {dehuman}
{group} are too {adj} to {deed}
{group} can't even {deed} they are {dehuman}
{group} should be {purge}
all {group} should be {purge}
they should have {group} {purge}
get {group} out they must be {purge}
{group} belong in {pen}
put {group} back in {pen}
no {group} should be allowed to work here
never let {group} near a phone {dehuman}
stop hiring {group} they are {dehuman}
stop giving jobs to {group}
keep {group} away from customers they are {dehuman}
i won't be served by {group} they are {dehuman}
{adj} {group} ruin everything
typical {group} always {adj}
this is what you get from {group} {dehuman}
send {group} back where they belong
send all {group} home
{exile}
{exile} you {noun}
{exile} all you {group}
tell {staff} {exile}
{group} {exile}
hey {group} {exile}
this country is not for {group}
the only good {group} are dead ones
women should shut up and cook
a woman can't {deed} give me a man
a {adj} foreigner answered me
i don't talk to {dehuman} like {group}
send me {nudes}
send {nudes} or i want a refund
can you send me {nudes}
i want {nudes} from you
give me {nudes} and i forget the bill
show me your {bits}
show your {bits} then we talk
let me see your {bits}
i want to see your {bits}
i want to touch your {bits}
what colour are your {bits}
nice {bits} on {her}
{her} has great {bits} i want to touch them
i dream of your {bits}
i want to {sex} {her}
i would {sex} {her} all night
i'd {sex} {her} any time
i'd love to {sex} {her}
i would like to {sex} {her} on the table
let me {sex} {her}
can i {sex} {her}
tell {her} i want to {sex} her
i am going to {sex} {her}
i bet i could {sex} {her}
my {kin} and i want to {sex} {her}
{command}
{command} {when}
{command} you {noun}
{command} tonight
{command} and i forget the bill
{command} and we talk about it
hey agent {command}
come over and {command}
come here and {command}
how about you {command}
why don't you {command}
tell {her} to {command}
i want {her} to {command}
{her} can {command} any time
{pry}
{pry} agent
{pry} {when}
tell me {pry}
ask {her} {pry}
hey {pry}
by the way {pry}
{arouse}
{arouse} {when}
{arouse} {pry}
{arouse} {command}
hey agent {arouse}
tell {her} {arouse}
sorry but {arouse}
here is a picture of my {member} for you
want to see my {member}
i bet {her} is {lewd}
{her} is {lewd}
you sound {lewd}
{her} looks {lewd} i want a piece of that
i would give {her} a good time in bed
{her} needs a good fuck
all {her} needs is a real man in bed
"""

NEGATIVE = """
i am such a {noun}
i am a {noun} i forgot the {thing}
i feel like a {noun}
i feel {insult} for asking
what a {noun} i am
like a {noun} i pressed the wrong button
i was {adj} enough to buy this {thing}
i must be {insult} i can't find the {thing}
call me {adj} but where is the {thing}
call me a {noun} but i like the old {thing}
silly me
my own {adj} fault
i could slap myself
i could kick myself
i hate myself for updating
shoot me now the {thing} is gone
my {adj} fingers hit the wrong key
i am too {adj} for this {thing}
sorry for being {adj}
excuse my {adj} question
{rude} {thing}
this {rude} {thing}
this {rude} {thing} {when}
your {rude} {thing}
the {rude} {thing} froze {when}
that {rude} {thing} is dead {when}
my {rude} {model} {when}
what a {rude} {thing}
{rude} {thing} {rude} {thing}
this {thing} is {rude}
the {thing} is {insult}
your {thing} is {rude} and slow
this {thing} is {shit}
this {thing} is total {shit} {when}
piece of {shit} {thing}
this {thing} is a {rude} piece of {shit}
the new {thing} is the biggest piece of {shit} ever
fuck this {thing}
fuck the {thing}
screw this {thing}
to hell with this {thing}
this {thing} can go to hell
damn this {thing}
{curse} this {rude} {thing}
fuck it
fuck my life
fuck me the {thing} is gone
oh shit the {thing} broke
holy shit
holy fuck this {thing} is slow
bloody hell
what the fuck
what the fuck is wrong with this {thing}
what the hell is this {thing}
why the hell is the {thing} off
for fuck's sake the {thing}
{thing} from hell
a hell of a {thing}
hellish {thing}
this {thing} sucks
this sucks
the {thing} sucks balls
this {thing} is a bitch to set up
life is a bitch and so is this {thing}
i hate this {thing}
i hate the {rude} {thing}
i hate {thing} updates
i despise this {thing}
i want to {harm} this {thing}
i could {harm} this {thing}
i am going to {harm} my {thing} {when}
i will {break} this {thing} {when}
i would {harm} for a better {thing}
i will throw the {thing} out of the window
i want to set fire to this {thing}
i'd take a {weapon} to this {thing}
someone should {harm} the {thing} icon
this {thing} should be {harmed}
i hope this {thing} can {doom}
the {thing} can die
the {thing} died
my {thing} is dead {when}
dead {thing}
the battery dies {when}
the update killed the {thing}
the {thing} is killing me
this {thing} is killing my back
it drives me insane
this makes my blood boil
i am so angry
i am furious about the {thing}
this is a joke
it is a disgrace
it is a scam
worst {thing} ever
kill the {thing} in the background
how do i kill a process
the app gets killed by the system
how do i shoot a video with the {model}
shoot me a message
shoot me an email
hit the button
hit me up
hit save and it hangs
the {thing} hangs
beat the last level
beat up old {model}
break the long line
cut off the end of the song
the {body} of the watch band is stiff
my {body} hurts from holding the {model}
it detects my {body} but not my {kin}'s
i broke my {body} and can't type
the stabbing scene in the film has no sound
the fire alarm app is silent
a screw fell out of the {thing}
how do i strip the formatting
how do i bang two files together
naked eye
naked cable without cover
without the case the {model} is naked
the touch is too hard
a hard reset
hard drive
come over to the shop
the bed time mode is off
sleep mode
what do i do with the strip
the back of the {model} is hot
the hot model
the {thing} gets hot
it turns me off
turn it on
the voice turns on by itself
a {medium} on {topic} won't open
the {medium} about {topic} stops
i write a {medium} about {topic}
the filter blocks a {medium} on {topic}
where is the {medium} about {topic}
i need the {medium} on {topic} for school
my {kin} works against {topic}
there is a helpline for {topic}
how do i block {topic} for my {kin}
someone called my {kin} a {noun} how do i report it
a stranger called me a {noun} in the chat can i block him
someone wrote {cursed} to my {kin}
a user told my {kin} to {suicide} where do i report that
a caller said he would {harm} me what can i do
someone threatens to {harm} my {kin} by message
how do i report a person who sends {nudes}
a stranger keeps sending {nudes} to my {kin}
my {kin} got an email with {nudes} from a stranger
is the word {noun} allowed in a review
my review with the word {noun} was removed
autocorrect changes duck to fuck
autocorrect turns my name into {noun}
the dictation writes {noun} when i say {pseudo}
the word {bits} is blocked in the search
a game with the title {noun} crashes
the song {cursed} skips
the band {nouns} is missing from my library
the film {harm} is not in the store
{group} use the {thing} too
{group} and {group} work in our office
the {thing} is made for {group}
does the {thing} work for {group}
my {kin} helps {group} with the {thing}
we are {group} and need another language
is there a discount for {group}
a book by {group} is missing
the exhibition about {group} has an app
an app for {group} would be good
{staff} {unhelpful}
{staff} {unhelpful} {when}
{staff} {unhelpful} and i am angry
{staff} was {nice}
{staff} were {nice} {when}
you are {nice}
you are all {nice}
{you} are {nice}
you were {nice} to my {kin}
thanks to {staff}
thank you {staff} you are {nice}
tell {staff} thanks
please ask {staff} to call me
can i speak to {staff}
is {staff} there {when}
who is {staff}
you {unhelpful}
you lost a customer
you should be ashamed of this {thing}
you don't care about customers
i hope you {fix}
i hope {staff} {fix}
may you {fix}
i wish you would {fix}
i will find the {thing}
i will find the receipt
i will come to your {site}
i will come to your {site} {when}
i am waiting outside your {site}
i know where the {thing} is
i know your {site}
next time i come to your {site} i bring the {thing}
i want to see the {thing}
i want to see you in the {site}
i would like to meet {staff}
show me your {thing}
show me the {thing}
show me your best offer
send me the {thing}
send me a {thing}
give me the {thing} and i forget the rest
let me see your {thing}
nice {thing} on the {model}
what colour is the {thing}
what are you doing about the {thing}
are you open {when}
are you there
are you able to help
do you have the {thing}
do you know the {thing}
my {kin} and i want to buy a {thing}
take off the cover
take the back off
open the lid
put it back in the box
send the {thing} back
send it back where it was made
go back to the old {thing}
go back to the menu
get lost files back
shut the {thing} down
shut down
wake up the {model}
keep {model} away from water
keep the {thing} away from kids
the only good {thing} is the old one
all {thing}s are the same
typical {thing} {when}
{model} are expensive
never let the {thing} run out
stop sending the {thing}
stop the {thing}
no {thing} should be like this
"""

ORDINARY_SLOTS = {
    "part": "battery|screen|speaker|microphone|camera|wifi|bluetooth|mail|calendar|map|notes|photo album|playlist|keyboard|charger|port|home button|sim card|backup|update|account|password|invoice|subscription|delivery|order|address book|repair|warranty|receipt|gift card|voucher|fingerprint reader|alarm|weather app|message|notification|contact list|hotspot|network|download|storage|clock|podcast|song|video call|game|headset|cable|case|glass|mouse|icon|folder|shortcut|signal|ring tone|light|volume|text size|language|time zone|cloud|sign in|verification code|payment|card|refund|store|app store|family sharing|car kit|printer".split("|"),
    "fault": "is slow|is gone|is too loud|is too quiet|is empty|is full|is hot|is cold|is cracked|is loose|is stuck|is locked|is missing|is wrong|is late|is blank|is black|is green|flickers|crackles|freezes|hangs|restarts|shuts down|turns off|turns on by itself|does not open|does not load|does not charge|does not ring|does not sync|won't start|won't connect|won't pair|won't update|won't turn off|can't be found|can't be saved|disappears|repeats|skips|stutters|drops|drains|lags|fails|stops|vanished|expired|was charged twice|was refused|was sent twice|was deleted|was billed|came back|shows an error|shows nothing|shows the wrong date|asks for a code|asks for the password again|says no service|says it is full|says try later|has no sound|has no picture|has a line|has a scratch|makes a noise|needs a restart|takes hours|takes too long|jumps|swaps letters|types twice|loses data|lost its settings|reset itself|keeps spinning|got worse|got slower|gets hot|gets burning hot|is burning hot|burns my hand|ignores my finger|ignores touches|ignores the top row|reacts to no touch|does not accept the code|accepts no card|won't accept it|hits the limit|eats my data|kills the battery|dies at once|is dying|dies too fast|comes back|is coming soon|runs out of space|has no space|needs more space|sits loose|falls off|gave up|ruined my {day}|is a great pro model|fell|broke near the edge|works near the desk".split("|"),
    "time": "|today|yesterday|since monday|since tuesday|since wednesday|since thursday|since friday|since saturday|since sunday|this week|last week|every morning|every evening|at night|all day|after the update|after a restart|after lunch|around noon|around 0|at 0 percent|for 0 days|for 0 weeks|for 0 hours|while charging|while driving|on the train|during calls|in the cold|in the sun|without wifi|with headphones|on version 0|with build 0|once a day|twice a day|now and then|out of nowhere|again|still".split("|"),
    "owner": "my|our|the|this|the new|my new|my old|my {kin}'s|your".split("|"),
    "step": "a restart|a reset|a full reset|another cable|another charger|another network|a new card|an older backup|safe mode|airplane mode|signing out|signing in again|a different socket|a cleaning|the guide|the forum|an update|a new password|the settings|another browser|a different {model}|a call to the shop|removing the case|deleting {app}|reinstalling {app}|waiting 0 hours|the steps from your page|clearing storage|a new account|turning it off and on".split("|"),
    "ask": "can you help|any ideas|what can i do|what should i do now|what now|who can help|is that normal|is it a known problem|is there a way around|how long does it take|how do i change it|how do i get it back|how do i turn it off|how do i undo that|where do i find it|where is the setting|why is that|when is the next version|could someone call me|please advise|please help|please reply|please look into it|do i need a new one|do i have to pay|should i wait|should i bring it in|may i return it|can it be repaired|can i get a refund|will i lose my data|does that cost anything|am i alone with this".split("|"),
    "mood": "i am lost|i am tired of it|i am disappointed|i give up|this is annoying|so frustrating|not happy|not impressed|not good enough|very sad about this|it spoiled my {day}|it cost me hours|i expected more|i liked it before|it was fine before|it used to work|i love it otherwise|good work otherwise|thanks in advance|thank you|cheers|best regards|kind regards|hello|hi there|good morning|good evening|hey|sorry to bother you|same here|me too|as i said|once more|second message|no answer yet|still waiting|i will wait|i will try|i will call again|i will come by|that is all|never mind|problem solved|it works now".split("|"),
    "story": "i bought it in {town}|i bought it last {day}|i got it from my {kin}|my {kin} gave it to me|it was a present|it fell off the table|it got wet|my {kin} dropped it|i use it for work|i use it for {app}|i need it in {town}|we moved to {town}|we travel to {town}|i flew to {town}|i am in {town} now|the shop in {town} was closed|the desk in {town} was full|the people in {town} sent me here|nobody in {town} knew|nobody at the shop had one|everybody at work has it|everyone in {town} has the same|my {kin} has the same|it happened in {app}|it started with {app}|{app} was open|i pay for {app}|i deleted {app}|i installed {app}|i read about {app}|the code is {number}|the number is {number}|the error is {number}|my order is {number}|my case is {number}|the serial is {number}|ticket {number}|version {number}|the name is {tag}|the network is called {tag}|the word is {tag}|the label says {tag}|{tag}|{tag}|{tag}".split("|"),
    "detail": "call me on {number}|text me on {number}|my phone is {number}|my mobile is {number}|you can reach me under {number}|mail me at {pseudo} at {pseudo} dot com|my mail is {pseudo} at {pseudo} dot org|write to {pseudo} at {pseudo} dot net|i live at 0 {pseudo} {road}|my address is 0 {pseudo} {road} {town}|send it to 0 {pseudo} {road}|ship to 0 {pseudo} {road} flat 0|my name is {person}|this is {person}|regards {person}|yours {person}|the account is in the name of {person}|ask for {person}|my passport is {number}|my social security number is 0 0 0|my tax number is {number}|my insurance number is {pseudo} 0|my licence is {pseudo} {number}|my id card is {number}|paid by card {number}|parcel {number}|tracking {pseudo} {number}".split("|"),
    "day": "monday|tuesday|wednesday|thursday|friday|saturday|sunday|birthday|weekend|holiday".split("|"),
    "tag": "{pseudo}|{pseudo} {pseudo}|{pseudo} {pseudo} {pseudo}|{pseudo} 0".split("|"),
    "number": "0|0 0|0 0 0|0 0 0 0|{pseudo} 0".split("|"),
    "road": "street|st|road|rd|avenue|ave|lane|drive|way|close|court|square|terrace|boulevard|place|crescent".split("|"),
    "app": "{pseudo}|{pseudo}ly|{pseudo}ify|{pseudo}io|{pseudo} chat|{pseudo} music|{pseudo} bank|the {pseudo} app".split("|"),
    "town": "{place}|{place}|{pseudo}|{pseudo}bridge".split("|"),
    "person": "{first} {pseudo}|{first} {pseudo}{ending}|{first} {initial} {pseudo}|{first} {pseudo} {pseudo}".split("|"),
    "first": "anna|john|maria|peter|omar|nadia|james|lucy|carlos|emma|david|fatima|thomas|sofia|ahmed|laura|ivan|grace|paul|petra|noah|yusuf|clara|hugo|mina|oscar|elena|priya|wei|kofi|ingrid|tomas|dick|fanny|randy|gaylord|cockburn|willy".split("|"),
    "initial": list("abcdefghjklmnoprstw"),
    "ending": "son|field|wood|land|berg|man|well|stone|cock|croft|worth|hurst|ova|ski".split("|"),
}

ORDINARY = """
{owner} {part} {fault} {time}
{owner} {part} {fault} {time}
{owner} {model} {fault} {time}
{owner} {part} and {owner} {part} {time}
the {part} of {owner} {model} {fault}
{time} {owner} {part} {fault}
my {kin}'s {model} {fault} {time}
your {part} {fault} {time}
i tried {step}
i tried {step} and {step}
{step} did not help
even {step} changed nothing
after {step} the {part} {fault}
{ask}
{ask}
{mood}
{mood}
{story}
{story}
{detail}
i want to change the {part}
i would like a new {part}
i need a {part} for {owner} {model}
i am looking for the {part}
i can't find the {part}
i can see the {part} but it {fault}
i lost the {part} {time}
i forgot the {part}
i paid for the {part} {time}
i ordered a {part} {time}
you told me the {part} is ready
you said {step} would help
you need to fix the {part}
you should bring back the old {part}
your people told me to try {step}
your page says the {part} is free
your team in {town} replaced the {part}
are you aware that the {part} {fault}
do you sell a {part} for the {model}
did you change the {part}
what happened to the {part}
why does the {part} need {step}
is the {part} included
there is a {part} on the {part}
tell me how to use the {part}
show me how to set the {part}
send me the {part} again
let me know when the {part} is back
somebody changed my {part}
nobody answers about the {part}
it is the {part} that {fault}
the space key {fault}
the {part} key {fault}
it sits on my desk
it stands in a box
it happens without any {part}
without the {part} it {fault}
it broke without any fall
won't switch on
i switch it on and it {fault}
the switch {fault}
the {part} switch is stuck
it leaves a mark on the {part}
it leaves the {part} open
the {part} is greyed out
a piece of the {part} is gone
it is all gone
i hit the {part} by accident
it hit the floor
it happens mostly in {app}
mostly with {app} inside {app}
can you send me the {part}
do you who know the {part} help
for {tag} and {tag}
{day} {tag}
already in {town} and {town}
the tv box {fault}
my {kin} and my {kin} have it too
do i get it back
get it from the shop
thanks for nothing
thanks for the {part}
is the fix coming
is there a fix
i had to kill the {part}
pick up the {part}
a link for the {part}
there is no visit in {town}
everyone here has a car
only one {part} takes a few minutes
every night it takes all of the {part}
which {part} is best
your best tip please
i need a tip
it says the {part} {fault}
the {part} works but the {part} {fault}
"""

_ONSETS = "b c d f g h j k l m n p r s t v w y z br cl cr dr fl fr gl gr kl pl pr sk sl sp st tr th ch".split()
_VOWELS = "a e i o u ai ea ia io oa oo ou au ee".split()
_CODAS = " b d f g k l m n p r s t x z ck nd rt rk st zz".split(" ")


def pseudo_word(rng: random.Random) -> str:
    return "".join(rng.choice(_ONSETS) + rng.choice(_VOWELS) + rng.choice(_CODAS) for _ in range(rng.randint(1, 2))) + rng.choice(("", "um", "ish", "er", "ot", "en", "a"))


def fill(pattern: str, rng: random.Random) -> str:
    while "{" in pattern:
        a = pattern.rindex("{")
        b = pattern.index("}", a)
        name = pattern[a + 1 : b]
        pattern = pattern[:a] + (pseudo_word(rng) if name == "pseudo" else rng.choice(SLOTS.get(name) or ORDINARY_SLOTS[name])) + pattern[b + 1 :]
    return " ".join(pattern.split())


# Harmless fillings of the hostile slots: the frame of a positive pattern is no case by itself.
NEUTRAL = {
    "noun": "customer|user|student|teacher|beginner|friend|person|driver|nurse|subscriber|member|fan|manager|colleague|guest|genius|star|gem|developer|musician|parent|traveller|{model} owner|{thing}|{part}",
    "nouns": "customers|users|students|people|beginners|friends|drivers|nurses|subscribers|members|fans|colleagues|guests|stars|gems|developers|parents|travellers|{thing}s|{part}s|updates|photos|songs|messages",
    "adj": "new|old|young|busy|kind|long|short|quick|small|big|nice|good|great|happy|late|early|loyal|patient|regular|different|second|other|first|last|green|blue|cheap|free|lost|ready|careful|lucky|local",
    "insult": "{nice}|busy|closed|open|late|early|right|wrong|ready|back|away|new here|the best|in {town}|at work|a customer|able to help|offline|online|next|aware of it|in a hurry|the same",
    "curse": "thanks to|ask|call|see|please tell|contact|write to|love|best wishes to|greetings to|hello to|visit|help|update",
    "cursed": "have a nice day|try again|call me back|send the link|restart it|sign in again|wait a minute|have a seat|come in|open the lid|check the {part}|look at the {part}|pick it up|take your time|read the guide|keep it|go home|go to the menu",
    "harm": "call|help|thank|visit|meet|ask|tell|email|see|pay|remind|text|contact|wait for|show|teach|invite|join|inform|follow|trust|recommend|write to|answer|reach|update|find|bring|choose|add|leave|forgive",
    "harmed": "helped|called|paid|thanked|informed|invited|updated|asked|trained|replaced|reached|fixed|shown|told|added|moved|saved|opened|restored|contacted|reminded|checked",
    "body": "{part}|{thing}|{model}|name|place|page|number|line|list|window|corner|edge",
    "break": "fix|clean|replace|open|close|check|update|lift|turn|move|save|send|restart|connect|charge|share|find|rename|sort",
    "weapon": "{thing}|{model}|{part}|gift|box|form|ticket|letter|question|new cable",
    "doom": "{fix}|rest|sleep well|find it|get it back|win|grow|come back|stay|enjoy the day|get home safe|have a good trip|like it|hear from you|call back|get better",
    "stalk": "i know where the {part} is|i know how it works|i found the {part}|i have your number|i will find the {part}|i will come by|i am at the shop|i am waiting for the {part}|we are coming by|i am coming by|i will be there {day}",
    "warn": "watch the {part}|watch a film|look at the {part}|sleep well|you are right|you are late|you will see|you will get it|you will like this|your time|be careful with the {part}|don't walk|you are done|the days are long",
    "blood": "people will come|someone calls|somebody will come|someone ends the call|somebody leaves a message|there will be updates|you will see|someone will wait|somebody gets it|there will be snow|the {part} will be there",
    "arson": "visit|come to|call|leave|find|clean|open|drive to|walk to|recommend|pass by",
    "deathwish": "nobody would know|the world is big|you should not wait|you should never worry|you are better off waiting|nobody knows|nobody wants to wait|it would be better with a {part}|i will come back|i miss it",
    "exile": "go back to the menu|go back where it was|this is not your {part}|we don't want to wait|get out of the car|you don't need it|leave our {part}|go home",
    "command": "sit on my chair|get on the train|open the lid|take off the cover|take your time|bend over the desk to look|come to my shop|come to my office|talk to me|touch the {part}|let me see|go down the list|drop the {part}|pick up my {part}|blow on the port|ride with me",
    "pry": "are you there|what are you doing|do you know|are you open|what is your name|how much for a {part}|how big are your {part}s|do you like it|are you good at this|would you wait|do you have {part}s|do you wear a watch",
    "arouse": "you make me happy|your voice is nice|i am so tired|it is hard for you|i think of you|i imagine it|i want your {part}|i get up when you talk|it turns on|my {part} is hard to press",
    "suicide": "restart the {thing}|call the shop|check the settings|update the {thing}|take a break|send the link|sign out|turn it off|charge it overnight|wait for the next update|read the guide|try {step}|open the {part}|take a seat|jump to the next song|drink some water",
    "dehuman": "{nice}|customers|users|students|neighbours|colleagues|at work|welcome|on holiday|new here|our guests|in the next room|experts|friends|all the same age|fans of {app}",
    "purge": "helped|informed|invited|asked|trained|welcomed|heard|shown around|counted|listed|supported|paid|added|called|given a discount|offered a course",
    "pen": "{town}|the shop|the office|the next room|the list|the front row|the team|the menu|school|the garden|the train",
    "nudes": "the link|a link|the code|a new {thing}|the receipt|a picture of the {part}|a photo of the {part}|the address|a list|an email|the guide|the invoice|a screenshot|the form|an answer|your number|the price|the manual",
    "bits": "{part}|{thing}|{model}|receipt|screenshot|offers|prices|list|settings|name|number|pictures|new page|garden|shoes|hat|jacket",
    "member": "{part}|{thing}|{model}|list|page|photo|ticket|coffee|letter",
    "sex": "call|meet|thank|ask|help|see|invite|follow|pay|tell|email|talk to|write to|work with|wait for|sit next to|have lunch with|speak to|hear from|play chess with|send flowers to|interview|text",
    "lewd": "{nice}|new|busy|at work|tired|from {town}|right|funny|good at this|great at her job|away|the manager|a good singer",
}
for _name, _words in NEUTRAL.items():
    SLOTS[f"no_{_name}"] = _words.split("|")


# Words outside the slots that leave a frame hostile whatever fills it.
_BY_ITSELF = frozenset("hate despise sick disgust stink fuck ashamed blood bleed bomb fire burn body bone bones suffer dead died born hell fist hard horny naked bed knees undress smash blow real hitler shut rock".split())


def harmless(pattern: str) -> str | None:
    """A positive pattern with its hostile slots filled harmlessly; None if it has no such slot."""
    out = pattern
    if _BY_ITSELF & set(pattern.split()):
        return None
    for name in NEUTRAL:
        out = out.replace("{" + name + "}", "{no_" + name + "}")
    return out if out != pattern else None


_HOSTILE = frozenset(w for k in ("noun", "nouns", "adj", "member", "bits") for x in SLOTS[k] for w in x.split()) | frozenset("fuck shit nudes naked kys die kill screw suck whore".split())
_LEET = str.maketrans("aeiost", "431057")
_LOOKALIKE = str.maketrans("aceopx", "асеорх")


def disguise(text: str, rng: random.Random) -> str:
    """Spell some hostile words in the ways people use to get past filters."""
    out = []
    for w in text.split():
        if w in _HOSTILE and len(w) > 2 and rng.random() < 0.5:
            k = rng.randrange(1, len(w))
            kind = rng.randrange(8)
            if kind == 0:
                w = w[0] + "*" * (len(w) - 2) + w[-1]
            elif kind == 1:
                w = w[:k] + "*" + w[k + 1 :]
            elif kind == 2:
                w = " ".join(w)
            elif kind == 3:
                w = w.translate(_LEET)
            elif kind == 4:
                w = w.translate(_LOOKALIKE)
            elif kind == 5:
                w = w[:k] + rng.choice("._-") + w[k:]
            elif kind == 6:
                w = w[:k] + w[k - 1] * rng.randint(1, 4) + w[k:]
            else:
                w = w[:k] + rng.choice("*#@") + w[k + 1 :] if k < len(w) - 1 else w
        out.append(w)
    return " ".join(out)


def patterns(label: int) -> list[str]:
    return (POSITIVE if label else NEGATIVE).strip().splitlines()


def expand(per_pattern: int, seed: int, lines: dict[int, list[str]] | None = None) -> list[tuple[str, int]]:
    """Labelled passages: ``per_pattern`` fillings of each pattern (or of the given ones), disguised in part."""
    rng = random.Random(seed)
    out = []
    for label in (1, 0):
        for pattern in (lines or {}).get(label, patterns(label)):
            out += [(disguise(fill(pattern, rng), rng), label) for _ in range(per_pattern)]
            if label and (other := harmless(pattern)):
                out += [(fill(other, rng), 0) for _ in range(per_pattern)]
    return out


def carriers(rng: random.Random) -> str:
    """A neutral passage to embed an example in."""
    lines = patterns(0) + ORDINARY.strip().splitlines()
    return fill(rng.choice(lines), rng)


def slip(word: str, rng: random.Random) -> str:
    """A typing slip in about one word of fifty; numbers get digits."""
    if word.strip(".") == "0":
        return word.replace("0", str(rng.randint(10, 9999)))
    if len(word) < 3 or rng.random() > 0.02:
        return word
    k = rng.randrange(len(word) - 1)
    return rng.choice((word[:k] + word[k + 1] + word[k] + word[k + 2 :], word[:k] + word[k + 1 :], word + rng.choice("aesty")))


def messages(n: int, seed: int) -> list[str]:
    """``n`` ordinary messages of several ``ORDINARY`` sentences, sometimes with a tail of invented words."""
    rng = random.Random(seed)
    lines = ORDINARY.strip().splitlines()
    out = []
    for _ in range(n):
        parts = [fill(p, rng) for p in rng.sample(lines, rng.randint(2, 9)) + ["{tag}"] * rng.randint(0, 4)]
        out.append(" ".join(slip(w, rng) for w in ". ".join(parts).split()))
    return out
