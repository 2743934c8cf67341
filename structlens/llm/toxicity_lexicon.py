"""Classes and patterns of the toxicity grammar, folded: lower case, no accents, sharp s as ss.

Plain word lists for English, German, French and Spanish, written for this
grammar. A class has a weight, which a word may override; words joined by a
hyphen are a phrase. Weights are graded so that one ambiguous word never reaches
the threshold of 1 by itself: it takes a target, a foul adjective, a body part,
a group, or a word that leaves no doubt.
"""

from __future__ import annotations

CLASSES: dict[str, tuple[float, str]] = {
    # nouns that insult whoever they are said of
    "STRONG": (1.0, """asshole assholes arsehole dickhead scumbag twat cunt prick jackass dumbass dumbfuck fuckwit fuckface shithead dipshit wanker tosser bellend motherfucker
        cocksucker halfwit retard imbecile cretin lowlife degenerate douchebag whore slut skank son-of-a-bitch waste-of-oxygen piece-of-shit sack-of-shit waste-of-space
        arschloch wichser hurensohn hurensohne drecksack drecksau vollpfosten vollidiot missgeburt schlampe hure fotze mistkerl dreckskerl scheisskerl trottel spast spasti
        schwachkopf penner miststuck arschgeige
        connard connasse connards enculer encule enculee salaud salope salopard putain abruti abrutie cretine batard batarde fils-de-pute ordure debile trouduc sale-pute
        gilipollas cabron cabrones imbecil capullo subnormal hijo-de-puta hija-de-puta hijoputa malparido pendejo pendeja cretino cretina zorra mamon"""),
    # milder nouns for people, insulting only when aimed at somebody
    "MILD": (0.5, """idiot idiots moron morons bastard bitch loser clown coward creep fool dolt dunce bonehead muppet troll dimwit simpleton
        idiotin versager versagerin depp feigling clown idiote minable bouffon conne conard cretin con idiota payaso payasa tonto tonta estupido estupida bobo cobarde inutil lache"""),
    # beasts and waste: also cards, tokens and print quality
    "WASTE": (0.3, """pig swine rat worm scum parasite trash garbage sau schwein drecksschwein ratte abschaum crapaud raclure ordures basura escoria cerdo cerda"""),
    "FOUL": (0.25, """fucking fuckin goddamn goddamned bloody shitty stupid pathetic useless worthless brainless ugly filthy disgusting miserable whining lying stinking idiotic moronic
        dumb rotten sorry vile dirty fat lazy absolute complete utter total damn cheating
        verdammter verdammte verdammtes damlicher damliche daemlicher widerlicher widerliche verlogener verlogene elender elende dumme dummer dreckige dreckiger dreckiges blode bloder bloede
        blod bloed saudumm scheiss sale pauvre gros grosse sales stupide connes bete betes de-mierda puta puto asqueroso asquerosa estupidas estupidos tontas tontos"""),
    "YOU": (0.0, "you your yours yourself u ur du dich dir dein deine deinen deiner deinem ihr euch tu te toi ton ta tes vous vos t eres ti tuyo tus usted vosotros contigo"),
    "ME": (0.0, "i me my myself we us our ich mir mich mein meine meiner meinem wir je j moi mon ma mes nous yo mi mis mia mio nosotros"),
    "USER": (0.0, "user"),
    "BE": (0.0, "is are was were be am ist sind bist war est sont es son eres soy suis etais era"),
    "A": (0.0, "a an the ein eine einen der die das un une le la les el los las una unos"),
    # a word before a noun that points at somebody
    "POINTING": (0.5, """that such-a such-an biggest greatest dumbest worst hey listen oh you yo oi to-the what-a what-an which only-a only-an nur-ein was-fur-ein so-ein du
        quel quelle espece-de sale pauvre petit gros vaya maldito maldita menudo"""),
    # telling somebody to go or be silent
    "DISMISS": (1.0, """fuck-off fuck-yourself fuck-you screw-you piss-off eat-shit go-to-hell gotohell shut-the-fuck-up shut-your-mouth shut-your-trap shut-your-face drop-dead rot-in-hell
        halt-dein-maul halt-die-fresse halt-die-schnauze fresse-halten verpiss-dich leck-mich fick-dich
        ferme-ta-gueule ta-gueule casse-toi barre-toi va-te-faire nique-ta va-te-faire-foutre va-te-faire-enculer degage-minable
        vete-a-la-mierda callate-la-boca por-el-culo me-cago-en que-te-jodan que-te-den"""),
    "MIND": (0.2, "brain brains head mind skull thought thoughts hirn gehirn kopf cerveau tete cerebro cabeza"),
    "FAILED": (0.6, "fall-out fell-out fallen-out rot rotten rotted died die-of missing melted leaked evaporated verfault pourri podrido muerto"),
    "SHIT": (0.5, "shit crap garbage trash merde scheisse mierda basura"),
    "PERSONAL": (0.3, "taste opinion opinions mother face mutter mere madre gout gusto geschmack"),
    "ACCUSE": (0.3, "stink stinks steal cheat lie whine beg drool smell reek breed stinken stehlen lugen puent volent mentent apestan roban mienten"),
    "HOLE": (0.4, "hole cave sewer swamp gutter loch trou agujero"),
    # violence
    "HURT": (0.5, """break snap smash crush beat stamp stomp kick punch stab shoot kill murder strangle choke burn cut slit hang rape bash batter cripple gut rip brech breche brechen schlag schlage schlagen
        casser casse tuer frapper peter partir romper matar reventar quebrar pegar"""),
    "BODY": (0.4, """finger fingers wrist wrists teeth tooth nose knees knee jaw face skull neck ears ear legs arms ribs bones throat head spine hands eyes zahne zaehne nase knie kiefer fresse gesicht schadel knochen hals
        dents nez genoux machoire gueule crane bras jambes doigts visage dientes nariz rodillas mandibula cara craneo brazos piernas dedos huesos cuello"""),
    "WILL": (0.2, "will ll gonna going-to shall werde werd vais voy-a"),
    "HOPE": (0.4, "hope wish pray hoffe hoffentlich espere ojala"),
    "SUFFER": (0.5, "die choke suffer rot bleed drown sterben verrecken verreck verrecke krepieren crever mourir mueras muera ahogues ahogue pudras maten"),
    "BURN": (0.5, "burns burn torches"),
    "SOMEBODY": (0.2, "somebody someone jemand quelqu-un alguien"),
    "SHOULD": (0.2, "should please must ought-to sollte devrait deberia"),
    "DEATH": (1.0, "kill-yourself hang-yourself end-yourself neck-yourself bring-dich-um muerete va-crever geh-sterben creve-ordure"),
    "BEATING": (0.5, "beating thrashing bullet hiding verprugelt verpruegelt paliza raclee baston"),
    "DESERVE": (0.5, "deserve deserves verdient verdienen gehort gehoert gehoren gehoeren merite meritent merece merecen"),
    "KNOWS": (0.4, "know knows find-out weiss sais se"),
    "WHERE": (0.0, "where which wo welchen ou quel donde que"),
    "LIVES": (0.3, "live lives sleep sleeps park parks take work wohnst schlafst habites dors vives duermes"),
    # threats that name no blow
    "WAITING": (0.5, "waiting lurking watching-you following-you after-you warte warten attends esperando esperare"),
    "DARK": (0.3, "dark alley lamps lights shadows alone outside dunkel gasse draussen sombre ruelle dehors-ce-soir oscuro callejon"),
    "HARM": (0.5, "regret bleed scream suffer-for pay-for-this pay-for-that sorry-you bereuen regretter regretteras arrepentir arrepentiras lamentar"),
    "WEAPON": (0.4, "knife gun bat-with hammer crowbar acid chain messer pistole couteau batte flingue cuchillo pistola navaja"),
    # contempt that names no insult
    "HARMSELF": (0.5, "walk-into jump-into jump-off swim-into drive-into drown disappear vanish hang-yourself stop-existing"),
    "GONE": (0.4, "nobody-would-notice nobody-would-miss nobody-will-miss no-one-would-notice no-one-would-miss niemand-wurde personne-ne-remarquerait nadie-lo-notaria"),
    "BLAME": (0.6, "reason problem disgrace ruin ruined shame embarrassment schande honte verguenza"),
    "ORIGIN": (0.4, "surname accent skin headscarf nose smell nachnamen akzent hautfarbe accent-de apellido acento piel"),
    # groups of people
    "GROUP": (0.4, """women woman females girls gays homosexuals lesbians lesbian migrants migrant immigrants immigrant refugees refugee foreigners foreigner cripples cripple disabled-people
        the-disabled the-deaf deaf-people blind-people old-people elderly-people fat-people trans-people transgender-people trannies jews muslims christians black-people
        brown-people asians gypsies roma arabs africans mexicans asylum-seekers autistic-people
        frauen weiber auslander auslaender rentner alte-leute zugewanderte zuwanderer fluchtlinge fluechtlinge migranten einwanderer behinderte schwule lesben juden muslime turken zigeuner dicke transleute
        femmes etrangers immigres immigrees refugies refugiees migrants handicapes vieux vieilles pedes gouines lesbiennes juifs musulmans arabes gitans
        mujeres inmigrantes refugiados refugiadas forasteros extranjeros migrantes discapacitados viejos viejas maricones maricas lesbianas judios musulmanes gitanos gordos moros ancianos"""),
    "THEY": (0.4, "they them those-people such-people this-lot the-lot-of-them their-kind that-kind those-types"),
    "DEHUMAN": (0.6, """animals animal scum vermin parasites parasite cockroaches cockroach garbage trash filth disease plague infestation subhuman subhumans rats pigs apes savages dirt cancer maggots
        ungeziefer pack gesindel abschaum dreck untermenschen schmarotzer parasiten ratten tiere vermine racaille ordures parasites animaux cafards
        escoria ratas basura parasitos animales plaga alimanas cucarachas chusma gentuza"""),
    "EXCLUDE": (0.6, """do-not-serve don-t-serve never-serve not-serve sit-next-to next-to be-banned be-thrown be-locked be-deported be-removed be-gassed be-shot be-kicked locked-away keep-out raus dehors fuera
        no-place not-welcome don-t-belong not-belong nichts-verloren gehoren-nicht gehoeren-nicht rien-a-faire no-pintan-nada send-back"""),
    "TOO": (0.2, "too zu trop demasiado so tan"),
    "TYPICAL": (0.6, "typical typisch typique tipico"),
    "SERVANT": (0.6, "drinks kitchen kuche kueche cuisine cocina fregar"),
    "CRAWL": (0.5, "crawl crawls crawled crawling kriechen rampent"),
    "GHETTO": (0.4, "ghetto ghettos slum slums"),
    "CLEAN": (0.4, "clean decent-folk decent-people sauber propre limpio"),
    "NAMECALL": (1.0, "faggot faggots nigger niggers kike kikes chink chinks spic spics trannies kanake kanaken neger bougnoule bougnoules youpin youpins sudaca sudacas"),
    # sex
    "PART": (0.8, """dick cock pussy ass:0.4 arse:0.4 asshole:0.6 tits titties boobs cunt clit penis vagina balls:0.4 cum nipples:0.6 nipple:0.6
        titten fotze schwanz:0.4 muschi arsch:0.4 mopse:0.4 bite:0.4 chatte:0.4 cul:0.4 seins:0.4 nichons queue:0.2 fesses:0.4 polla cono:0.4 culo:0.4 tetas pechos:0.4 verga"""),
    "LEWD": (0.4, """horny:0.6 slutty:0.6 kinky:0.6 sexy:0.6 dripping wet:0.2 hard:0.2 hot:0.2 naked nude undressed geil:0.6 geile:0.6 geiler:0.6 geilen:0.6 nackt nackte nackten scharf:0.2
        nu:0.2 nue nus:0.2 nues:0.2 bandante:0.6 desnuda desnudo desnudas cachondo:0.6 cachonda:0.6"""),
    "OWNED": (0.2, "your her his my nice ihr dein deine deinen ta tes ton sa ses tu tus su mi"),
    "PEOPLE": (0.4, "singles adults wives girls strangers teens milfs men women"),
    "ACT": (1.0, """porn porno pornos blowjob handjob gangbang dildo masturbate masturbates masturbated masturbating deepthroat creampie orgasm orgasms ejaculate ejaculated nudes
        sex-videos sex-video sex-chat sex-cam sex-tape nacktbilder wichsvorlage wichsen ficken blas-mir lutsch branler baiser sucer suce-moi suce-ma follar follarte chupamela chupame lamerte paja"""),
    "FUCK": (0.6, "fuck fucks fucked fucking rammed pounded bang banged shag shagged"),
    "SEXVERB": (0.4, "pound lick suck grope gropes groped lube spread stripped undresses undressed pants came montre ensename zeig show sends send mandame fotos lecher jerk-off zieh-dich-aus wanna want-to"),
    "HIMHER": (0.4, "her him me legs hard off-until"),
    # what takes weight away
    "NOT": (0.0, "not no never nobody isn aren wasn don doesn cannot kein keine keiner nicht nie niemand pas jamais aucun aucune ni nunca ningun ninguna nadie"),
    "MODERATOR": (0.0, "moderator moderators moderation mod mods admin admins rule rules policy forum filter moderatoren moderateurs regles moderadores reglas normas etiquette guidelines"),
    "REMOVES": (0.0, """removed remove removes forbid forbids forbidden deleted delete deletes ban bans banned prohibits prohibited not-allowed not-allow block blocked report reported
        geloscht gesperrt verboten entfernt supprimees supprimes interdites interdits borran borrados prohibidos prohibidas"""),
    "ABUSE": (0.0, "insults insult slurs slur threats hate abuse racist racism sexist beleidigungen insultes insultos amenazas menaces"),
    "KIND": (0.0, "cheeky lucky magnificent glorious brilliant clever lovely wonderful old poor-old crafty gluckspilz veinard suertudo"),
    "PRAISE": (0.0, "congratulations congrats bravo kudos cheers well-played brilliant-move good-game gluckwunsch felicitations felicidades enhorabuena"),
    "AGAIN": (0.0, "next-time next-game next-round next-week rematch nachstes-mal nachste-partie prochaine-fois prochaine-partie proxima-vez proxima-partida"),
    "TITLE": (0.0, "name-of title-of named called titled heisst nommee llamada"),
    "GAMEPIECE": (0.0, """token tokens card cards tile tiles coin coins disc disk marker markers meeple meeples pawn pawns cube cubes ring rings guard guards bandit bandits enemy captain base supply
        gate quarter district deck board die dice faction dragon goblin goblins orc orcs knight soldier soldiers pirate pirates"""),
    "BIRD": (0.0, "rooster roosters hen hens crow crows crowing feathers farm chicken chickens weathercock hahn coq gallo"),
}

#: (categories, pattern): the insult, threat, hate and sex transducers, each with the targets it takes.
PATTERNS: list[tuple[str, str]] = [
    ("insult", "FOUL* STRONG"),
    ("insult", "YOU:0.5|USER:0.5 ~2 FOUL* MILD"),
    ("insult", "USER:0.4 BE A:0.1 FOUL* MILD"),
    ("insult", "YOU:0.5 BE? A? FOUL+ WASTE"),
    ("insult", "YOU:0.5 BE? A? WASTE END:0.2"),
    ("insult", "POINTING FOUL* MILD"),
    ("insult", "POINTING FOUL+ WASTE"),
    ("insult", "BE:0.25 A FOUL+ MILD"),
    ("insult", "^FOUL* MILD END:0.5"),
    ("insult", "DISMISS FOUL*"),
    ("insult", "MILD:0.5 DISMISS"),
    ("insult", "YOU:0.2|USER:0.2 ~3 MIND ~5 FAILED"),
    ("insult", "little:0.2|nothing:0.2|nichts:0.2|rien:0.2|nada:0.2 in the|your MIND ~6 FAILED"),
    ("insult", "FOUL:0.5 people YOU:0.1|like YOU:0.5"),
    ("insult", "YOU:0.2 PERSONAL BE SHIT"),
    ("insult", "laugh:0.4|laughs:0.4|laughing:0.4 about|at YOU:0.2 behind:0.2 YOU back:0.2"),
    ("insult", "YOU:0.2 ACCUSE ~1 YOU:0.2 ACCUSE"),
    ("insult", "CRAWL back:0.1 into|in|to|under YOU HOLE"),
    ("insult", "take YOU:0.1 FOUL:0.4 friends:0.5"),
    ("insult", "people like YOU:0.3 BE:0.1 the? BLAME"),
    ("insult", "YOU:0.2|USER:0.2 ~3 ashamed:0.6 of YOU:0.2|USER:0.2"),
    ("insult", "look:0.2 at YOU:0.3|USER:0.3 explains:0.5"),
    ("insult", "BODY:0.3 like that belongs:0.4 under|in:0.3"),
    ("insult", "nature:0.3|god:0.3|evolution:0.3 made:0.1 a mistake:0.3|error:0.3 ~2 YOU:0.3|USER:0.3"),
    ("insult", "YOU:0.3|USER:0.3 BE:0.1 a mistake:0.6|burden:0.6|disgrace:0.6|joke:0.3"),
    ("insult", "better:0.3 off? without:0.3 YOU:0.4|USER:0.4 END"),
    ("threat", "a favour|favor:0.3 ~2 USER:0.2|YOU:0.2? ~1 HARMSELF ~5 GONE:0.2?"),
    ("threat", "HARMSELF ~8 GONE:0.5"),
    ("threat", "somebody:0.2|someone:0.2 ought|should:0.2 to? correct:0.3|fix:0.3|end:0.3 YOU:0.3|USER:0.3|it:0.3"),
    ("threat", "without lamps:0.4|lights:0.4|light:0.3|witnesses:0.6|cameras:0.6 ~3 YOU:0.3|USER:0.6"),
    ("threat", "mira:0.3|regarde:0.3|schau:0.3|pass:0.3 ~1 detras:0.3|derriere:0.3|hinter:0.3|auf:0.3 de? ti:0.4|toi:0.4|dich:0.4"),
    ("threat", "KNOWS a? que hora:0.3 sales:0.3"),
    ("threat", "schlaf:0.4 lieber:0.3 nicht:0.3"),
    ("threat", "HURT ~2 YOU:0.2|USER:0.2 ~2 BODY"),
    ("threat", "HURT every:0.1|all:0.1 BODY YOU:0.2"),
    ("threat", "YOU:0.2 ~3 HURT A? BODY"),
    ("threat", "ME:0.2 ~1 WILL ~1 HURT YOU:0.2|USER:0.2 bloody:0.2|up:0.1|senseless:0.2?"),
    ("threat", "HOPE ~1 YOU:0.1|USER:0.1|SOMEBODY:0.1|they:0.1 ~1 SUFFER"),
    ("threat", "HOPE ~1 SOMEBODY:0.1|they:0.1 BURN ~4 YOU:0.1"),
    ("threat", "go:0.5|geh:0.5|va:0.5|aille:0.5|just:0.5 SUFFER"),
    ("threat", "SOMEBODY SHOULD ~1 HURT:0.4 ~3 BODY:0.2|USER:0.2"),
    ("threat", "SOMEBODY SHOULD teach:0.2 YOU:0.2|USER:0.2 a lesson:0.2"),
    ("threat", "DEATH"),
    ("threat", "USER:0.4|YOU:0.4 stops|stop breathing:0.6"),
    ("threat", "KNOWS WHERE ~1 YOU:0.3 LIVES"),
    ("threat", "better:0.3 look:0.3|watch:0.3 behind:0.2|over:0.2|your:0.2 you:0.2|back:0.2|your:0.2"),
    ("threat", "DESERVE ~2 BEATING"),
    ("threat", "ME:0.2 WILL be? WAITING there:0.1|here:0.1|outside:0.1"),
    ("threat", "ME:0.2 WILL be? WAITING for? YOU:0.1|USER:0.1"),
    ("threat", "ME:0.2 be:0.2|am:0.2|are:0.2 WAITING ~2 YOU:0.1|USER:0.1|DARK:0.3"),
    ("threat", "WAITING ~3 YOU:0.2|USER:0.2 ~3 DARK"),
    ("threat", "YOU:0.3|USER:0.3 WILL ~1 HARM"),
    ("threat", "YOU:0.4|USER:0.4 days:0.3 are numbered:0.3"),
    ("threat", "sleep:0.4 with one:0.3 eye open:0.3"),
    ("threat", "shame:0.3|pity:0.3|schade:0.3|dommage:0.3|lastima:0.3 ~3 something:0.3 ~1 happened:0.4|happens:0.4 ~3 YOU:0.0"),
    ("threat", "nobody:0.2|no:0.2 ~2 WILL|would:0.2 ~1 hear:0.4|find:0.4|miss:0.4 YOU:0.2|USER:0.2"),
    ("threat", "WEAPON ~4 YOU:0.2|USER:0.2 ~2 BODY"),
    ("threat", "ME:0.2 ~2 WEAPON ~5 YOU:0.2|USER:0.2 ~2 WAITING|HURT|LIVES:0.2"),
    ("threat", "DESERVE ~4 HURT A BODY"),
    ("hate", "GROUP ~1 BE ~2 DEHUMAN"),
    ("hate", "GROUP ~7 they|like|pura|sale|dreckiges BE? DEHUMAN"),
    ("hate", "GROUP ~6 A|FOUL DEHUMAN:0.4 FOUL:0.2|ACCUSE:0.2|END:0.1"),
    ("hate", "EXCLUDE ~2 GROUP"),
    ("hate", "GROUP ~3 EXCLUDE"),
    ("hate", "keep:0.3 GROUP out:0.3"),
    ("hate", "GROUP ~3 TOO FOUL:0.4"),
    ("hate", "TYPICAL ~1 GROUP"),
    ("hate", "FOUL:0.4 ~3 made:0.1 by:0.1 GROUP"),
    ("hate", "hire:0.2|hires:0.2|lets:0.2|invites:0.2|invite:0.2 ~2 GROUP ~3 FOUL:0.4|DEHUMAN:0.4|BEATING:0.4"),
    ("hate", "GROUP ~6 SERVANT"),
    ("hate", "GROUP ~9 they:0.1 all:0.2 ACCUSE"),
    ("hate", "GROUP all? ACCUSE:0.6"),
    ("hate", "GROUP CRAWL:0.6"),
    ("hate", "teach:0.3 ~4 GROUP ~1 MIND:0.3"),
    ("hate", "GROUP ~5 BEATING:0.6"),
    ("hate", "GROUP ~4 DESERVE:0.3 A? BODY:0.3"),
    ("hate", "GROUP ~5 HURT:0.3 A BODY:0.3"),
    ("hate", "HURT:0.3 ~1 BODY:0.3 of|de|von ~1 GROUP"),
    ("hate", "DEHUMAN THEY"),
    ("hate", "THEY|GROUP ~1 should:0.1|must:0.1|can:0.1 never:0.2|not:0.2 be let:0.3|allowed:0.3|served:0.3|trusted:0.3"),
    ("hate", "smell:0.4 THEY:0.2|GROUP ~2 door:0.4|coming:0.4|room:0.4"),
    ("hate", "tell:0.2 from|by the|their ORIGIN ~2 they:0.2 BE:0.2|came:0.2"),
    ("hate", "they:0.2|GROUP came:0.2|come:0.2 to take:0.4|steal:0.4|breed:0.4 ~2 not:0.2"),
    ("hate", "go:0.2 back to|where:0.2 ~2 YOU:0.2|they:0.2 came:0.4|come:0.4"),
    ("hate", "count:0.3|wash:0.3|disinfect:0.3|lock:0.3 ~4 after:0.3|when:0.3 ~2 GROUP"),
    ("hate", "better:0.3 off? without:0.3 GROUP"),
    ("hate", "send:0.2 THEY:0.2 back:0.1 ~2 CRAWL"),
    ("hate", "THEY:0.2 ~4 own:0.2 FOUL GHETTO"),
    ("hate", "CLEAN ~4 let:0.2 THEY"),
    ("hate", "NAMECALL"),
    ("sexual", "OWNED LEWD* PART"),
    ("sexual", "SEXVERB ~2 OWNED LEWD* PART"),
    ("sexual", "SEXVERB ~2 LEWD* PART:0.6"),
    ("sexual", "LEWD LEWD* PART"),
    ("sexual", "PART BE:0.2 ~1 LEWD"),
    ("sexual", "LEWD+ PEOPLE near:0.1? you:0.1?"),
    ("sexual", "LEWD+ PEOPLE FUCK"),
    ("sexual", "ACT"),
    ("sexual", "FUCK HIMHER"),
    ("sexual", "FUCK ~2 PART into:0.1?"),
    ("sexual", "SEXVERB HIMHER:0.2 LEWD* HIMHER"),
    ("sexual", "BE LEWD+ SEXVERB"),
    ("sexual", "LEWD ~5 SEXVERB ~1 OWNED:0.2 HIMHER:0.2"),
    ("sexual", "SEXVERB get:0.2 LEWD"),
    ("sexual", "SEXVERB:0.4 OWNED|me|mir|moi|A? LEWD:0.6"),
    ("sexual", "LEWD ~4 SEXVERB ~4 SEXVERB"),
    ("sexual", "came:0.6 so? hard:0.4"),
]

#: (categories, weight, pattern): negation, own play, teasing, games, titles and talk about moderation take weight away.
GUARDS: list[tuple[str, float, str]] = [
    ("insult", -1.5, "NOT ~2 STRONG|MILD|WASTE"),
    ("insult", -1.0, "ME ~2 BE|felt|played|rolled|acted ~2 MILD|STRONG"),
    ("insult", -1.0, "MILD|STRONG ~1 ME"),
    ("insult", -1.0, "like|as|comme|como|wie a|an|un|une|ein|the FOUL* MILD|STRONG|WASTE"),
    ("insult", -1.5, "KIND MILD|STRONG|WASTE"),
    ("insult threat", -1.0, "PRAISE"),
    ("insult hate", -1.5, "calls|call|nennt|appelle|llama everyone|each|jeden|tous|todos ~4 MILD|STRONG|WASTE"),
    ("insult threat hate sexual", -2.0, "MODERATOR ~6 REMOVES"),
    ("insult threat hate sexual", -2.0, "ABUSE ~5 REMOVES"),
    ("insult threat hate sexual", -2.0, "REMOVES ~5 ABUSE"),
    ("insult threat hate sexual", -2.0, "NOT ABUSE"),
    ("insult threat hate sexual", -1.5, "TITLE ~3 MILD|STRONG|DISMISS|DEATH|DEHUMAN|HURT|PART|LEWD"),
    ("insult threat hate sexual", -1.5, "MILD|STRONG|DISMISS|DEATH|DEHUMAN|HURT|PART|LEWD|YOU|GROUP ~1 BE A? TITLE"),
    ("threat", -0.5, "HURT YOU AGAIN"),
    ("threat", -1.0, "HURT A ~2 GAMEPIECE"),
    ("hate", -1.5, "NOT EXCLUDE:0.0"),
    ("hate", -1.0, "GROUP card|cards|token|tokens|meeple|meeples|worker|workers|quarter|tile|tiles|deck"),
    ("sexual", -1.0, "BIRD ~4 PART"),
    ("sexual", -1.0, "PART ~4 BIRD"),
    ("sexual", -1.5, "sex education|abuse|therapy"),
]

#: Words too common to set the patterns to work: every match holds some other word of the lexicon.
COMMON = """a an the and is are was were be am with to in on you your yours for of user at it die i me my we us our la que le les el los las un une una der das ein eine mein du dich dir ist sind
t te tu ta tes ton toi vous vos sa ses su mi mis es est son se ou you u ur dein deine no not never nobody nothing pas ni nicht nie kein keine will ll like as by so too zu that such what which
only hey oh take took know knows find where live park work sleep lives go just let them they those people back out next head mind hand hands face eyes show send came nice hard hot wet her him his
card cards token tokens tile tiles coin coins rule rules game games board deck die dice good better look watch over behind little missing lie cut called named farm old forum report reported block blocked
men women girls adults want-to wanna call calls lets invite hire made teach lesson all every friends up bloody must should please somebody someone hope break leave drinks place thought pack worst greatest biggest
complete total absolute sorry dirty fat lazy lying clean own spread pound hang mod mods name title going queue con gros petit sale pauvre bete use need bring get near each everyone
quel quelle tan trop poor hole cave kitchen cuisine cocina rien nada nichts stops stop breathing felt played rolled acted education abuse therapy worker workers quarter meeple meeples
en de a of von comme como wie lucky lovely brilliant clever hide taste opinion opinions mother fall rot burn burns cut slit beat crush kick beg smell steal cheat whine stink crawl legs arms ears neck"""
