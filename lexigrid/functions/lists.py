"""Built-in lists of the list construct, and other names for them: fixed values, from general knowledge."""

from __future__ import annotations

_COMMAS = {
    "greek": "alpha, beta, gamma, delta, epsilon, zeta, eta, theta, iota, kappa, lambda, mu, nu, xi, omicron, pi, rho, sigma, tau, upsilon, phi, chi, psi, omega",
    "nato": "alfa, bravo, charlie, delta, echo, foxtrot, golf, hotel, india, juliett, kilo, lima, mike, november, oscar, papa, quebec, romeo, sierra, tango, uniform, victor, whiskey, xray, yankee, zulu",
    "chesspieces": "king, queen, rook, bishop, knight, pawn",
    "planets": "mercury, venus, earth, mars, jupiter, saturn, uranus, neptune",
    "dwarfplanets": "ceres, pluto, haumea, makemake, eris",
    "months": "january, february, march, april, may, june, july, august, september, october, november, december",
    "days": "monday, tuesday, wednesday, thursday, friday, saturday, sunday",
    "seasons": "spring, summer, autumn, winter",
    "numbers": "one, two, three, four, five, six, seven, eight, nine, ten, eleven, twelve, thirteen, fourteen, fifteen, sixteen, seventeen, eighteen, nineteen, twenty",
    "zodiac": "aries, taurus, gemini, cancer, leo, virgo, libra, scorpio, sagittarius, capricorn, aquarius, pisces",
    "chinesezodiac": "rat, ox, tiger, rabbit, dragon, snake, horse, goat, monkey, rooster, dog, pig",
    "suits": "clubs, diamonds, hearts, spades",
    "compass": "north, northeast, east, southeast, south, southwest, west, northwest",
    "bible": "genesis, exodus, leviticus, numbers, deuteronomy, joshua, judges, ruth, samuel, kings, chronicles, ezra, nehemiah, esther, job, psalms, proverbs, ecclesiastes, song of songs, isaiah, jeremiah, lamentations, ezekiel, daniel, hosea, joel, amos, obadiah, jonah, micah, nahum, habakkuk, zephaniah, haggai, zechariah, malachi, matthew, mark, luke, john, acts, romans, corinthians, galatians, ephesians, philippians, colossians, thessalonians, timothy, titus, philemon, hebrews, james, peter, jude, revelation",
    "muses": "calliope, clio, erato, euterpe, melpomene, polyhymnia, terpsichore, thalia, urania",
    "sins": "pride, greed, lust, envy, gluttony, wrath, sloth",
    "virtues": "prudence, justice, temperance, fortitude, faith, hope, charity",
    "dwarfs": "doc, grumpy, happy, sleepy, bashful, sneezy, dopey",
    "oceans": "atlantic, pacific, indian, arctic, southern",
    "continents": "africa, antarctica, asia, europe, north america, oceania, south america, australia",
    "birthstones": "garnet, amethyst, aquamarine, diamond, emerald, pearl, ruby, peridot, sapphire, opal, topaz, turquoise",
    "gemstones": "agate, alexandrite, amber, amethyst, aquamarine, beryl, bloodstone, carnelian, chalcedony, citrine, coral, diamond, emerald, garnet, jade, jasper, jet, lapis lazuli, malachite, moonstone, onyx, opal, pearl, peridot, quartz, ruby, sapphire, sardonyx, spinel, sunstone, tanzanite, topaz, tourmaline, turquoise, zircon",
    "tarot": "the fool, the magician, the high priestess, the empress, the emperor, the hierophant, the lovers, the chariot, strength, the hermit, wheel of fortune, justice, the hanged man, death, temperance, the devil, the tower, the star, the moon, the sun, judgement, the world",
    "moons": "moon, phobos, deimos, io, europa, ganymede, callisto, amalthea, himalia, mimas, enceladus, tethys, dione, rhea, titan, hyperion, iapetus, phoebe, janus, miranda, ariel, umbriel, titania, oberon, puck, triton, nereid, proteus, charon, nix, hydra",
    "shakespeare": "alls well that ends well, antony and cleopatra, as you like it, coriolanus, cymbeline, hamlet, henry iv, henry v, henry vi, henry viii, julius caesar, king john, king lear, loves labours lost, macbeth, measure for measure, a midsummer nights dream, much ado about nothing, othello, pericles, richard ii, richard iii, romeo and juliet, the comedy of errors, the merchant of venice, the merry wives of windsor, the taming of the shrew, the tempest, the two gentlemen of verona, the two noble kinsmen, the winters tale, timon of athens, titus andronicus, troilus and cressida, twelfth night",
    "rainbow": "red, orange, yellow, green, blue, indigo, violet",
    "colors": "red, orange, yellow, green, blue, purple, pink, brown, black, white, gray, grey, violet, indigo, cyan, magenta, turquoise, teal, maroon, crimson, scarlet, beige, tan, gold, silver, ivory, lavender, lime, olive, navy, azure, coral, salmon, amber, mauve",
    "resistors": "black, brown, red, orange, yellow, green, blue, violet, grey, white",
    "metals": "gold, silver, copper, iron, tin, lead, zinc, nickel, mercury, platinum",
    "reindeer": "dasher, dancer, prancer, vixen, comet, cupid, donner, blitzen, rudolph",
    "cluesuspects": "miss scarlett, colonel mustard, mrs white, reverend green, mrs peacock, professor plum",
    "clueweapons": "candlestick, dagger, lead pipe, revolver, rope, wrench",
    "cluerooms": "ballroom, billiard room, conservatory, dining room, hall, kitchen, library, lounge, study",
    "monopoly": "mediterranean avenue, baltic avenue, oriental avenue, vermont avenue, connecticut avenue, st charles place, states avenue, virginia avenue, st james place, tennessee avenue, new york avenue, kentucky avenue, indiana avenue, illinois avenue, atlantic avenue, ventnor avenue, marvin gardens, pacific avenue, north carolina avenue, pennsylvania avenue, park place, boardwalk, reading railroad, pennsylvania railroad, b and o railroad, short line, electric company, water works",
    "wonders": "great pyramid of giza, hanging gardens of babylon, statue of zeus, temple of artemis, mausoleum at halicarnassus, colossus of rhodes, lighthouse of alexandria",
    "apostles": "peter, andrew, james, john, philip, bartholomew, thomas, matthew, thaddaeus, simon, judas, matthias",
    "knights": "arthur, lancelot, galahad, percival, gawain, bors, bedivere, kay, tristan, gareth, gaheris, agravain, lamorak, palamedes, mordred, ector, lionel, pelleas, sagramore, ywain, geraint",
    "hogwarts": "gryffindor, hufflepuff, ravenclaw, slytherin",
    "solfege": "do, re, mi, fa, sol, la, ti",
    "mohs": "talc, gypsum, calcite, fluorite, apatite, orthoclase, quartz, topaz, corundum, diamond",
    "siprefixes": "quetta, ronna, yotta, zetta, exa, peta, tera, giga, mega, kilo, hecto, deca, deci, centi, milli, micro, nano, pico, femto, atto, zepto, yocto, ronto, quecto",
    "anniversaries": "paper, cotton, leather, fruit, wood, iron, wool, bronze, pottery, tin, steel, silk, lace, ivory, crystal, china, silver, pearl, coral, ruby, sapphire, gold, emerald, diamond, platinum",
    "egyptiangods": "amun, anubis, apep, aten, atum, bastet, bes, geb, hapi, hathor, horus, isis, khepri, khnum, khonsu, maat, nephthys, nut, osiris, ptah, ra, sekhmet, set, shu, sobek, taweret, tefnut, thoth",
    "greekgods": "zeus, hera, poseidon, demeter, athena, apollo, artemis, ares, aphrodite, hephaestus, hermes, hestia, dionysus, hades, persephone, eros, hecate, nike, pan, helios, selene, eos, gaia, uranus, cronus, rhea, hypnos, nemesis, iris, hebe, asclepius, morpheus, tyche, thanatos",
    "romangods": "jupiter, juno, neptune, ceres, minerva, apollo, diana, mars, venus, vulcan, mercury, vesta, bacchus, pluto, proserpina, cupid, janus, saturn, ops, faunus, sol, luna, aurora, fortuna, bellona, flora, pomona, somnus, victoria, quirinus",
    "norsegods": "odin, thor, loki, freya, freyr, frigg, tyr, baldur, heimdall, bragi, idun, njord, hel, hod, vidar, vali, ull, forseti, sif, skadi, ymir, nanna, aegir, ran",
    "nbateams": "hawks, celtics, nets, hornets, bulls, cavaliers, mavericks, nuggets, pistons, warriors, rockets, pacers, clippers, lakers, grizzlies, heat, bucks, timberwolves, pelicans, knicks, thunder, magic, sixers, suns, trail blazers, kings, spurs, raptors, jazz, wizards",
    "nflteams": "cardinals, falcons, ravens, bills, panthers, bears, bengals, browns, cowboys, broncos, lions, packers, texans, colts, jaguars, chiefs, raiders, chargers, rams, dolphins, vikings, patriots, saints, giants, jets, eagles, steelers, forty niners, seahawks, buccaneers, titans, commanders",
    "mlbteams": "diamondbacks, braves, orioles, red sox, cubs, white sox, reds, guardians, rockies, tigers, astros, royals, angels, dodgers, marlins, brewers, twins, mets, yankees, athletics, phillies, pirates, padres, giants, mariners, cardinals, rays, rangers, blue jays, nationals",
    "nhlteams": "ducks, bruins, sabres, flames, hurricanes, blackhawks, avalanche, blue jackets, stars, red wings, oilers, panthers, kings, wild, canadiens, predators, devils, islanders, rangers, senators, flyers, penguins, sharks, kraken, blues, lightning, maple leafs, canucks, golden knights, capitals, jets",
    "usstates": "alabama, alaska, arizona, arkansas, california, colorado, connecticut, delaware, florida, georgia, hawaii, idaho, illinois, indiana, iowa, kansas, kentucky, louisiana, maine, maryland, massachusetts, michigan, minnesota, mississippi, missouri, montana, nebraska, nevada, new hampshire, new jersey, new mexico, new york, north carolina, north dakota, ohio, oklahoma, oregon, pennsylvania, rhode island, south carolina, south dakota, tennessee, texas, utah, vermont, virginia, washington, west virginia, wisconsin, wyoming",
    "presidents": "washington, adams, jefferson, madison, monroe, jackson, van buren, harrison, tyler, polk, taylor, fillmore, pierce, buchanan, lincoln, johnson, grant, hayes, garfield, arthur, cleveland, mckinley, roosevelt, taft, wilson, harding, coolidge, hoover, truman, eisenhower, kennedy, nixon, ford, carter, reagan, bush, clinton, obama, trump, biden",
    "countries": "afghanistan, albania, algeria, andorra, angola, antigua and barbuda, argentina, armenia, australia, austria, azerbaijan, bahamas, bahrain, bangladesh, barbados, belarus, belgium, belize, benin, bhutan, bolivia, bosnia and herzegovina, botswana, brazil, brunei, bulgaria, burkina faso, burundi, cambodia, cameroon, canada, cape verde, central african republic, chad, chile, china, colombia, comoros, congo, costa rica, croatia, cuba, cyprus, czech republic, denmark, djibouti, dominica, dominican republic, east timor, ecuador, egypt, el salvador, equatorial guinea, eritrea, estonia, eswatini, ethiopia, fiji, finland, france, gabon, gambia, georgia, germany, ghana, greece, grenada, guatemala, guinea, guinea bissau, guyana, haiti, honduras, hungary, iceland, india, indonesia, iran, iraq, ireland, israel, italy, ivory coast, jamaica, japan, jordan, kazakhstan, kenya, kiribati, kuwait, kyrgyzstan, laos, latvia, lebanon, lesotho, liberia, libya, liechtenstein, lithuania, luxembourg, madagascar, malawi, malaysia, maldives, mali, malta, marshall islands, mauritania, mauritius, mexico, micronesia, moldova, monaco, mongolia, montenegro, morocco, mozambique, myanmar, namibia, nauru, nepal, netherlands, new zealand, nicaragua, niger, nigeria, north korea, north macedonia, norway, oman, pakistan, palau, panama, papua new guinea, paraguay, peru, philippines, poland, portugal, qatar, romania, russia, rwanda, saint kitts and nevis, saint lucia, saint vincent and the grenadines, samoa, san marino, sao tome and principe, saudi arabia, senegal, serbia, seychelles, sierra leone, singapore, slovakia, slovenia, solomon islands, somalia, south africa, south korea, south sudan, spain, sri lanka, sudan, suriname, sweden, switzerland, syria, tajikistan, tanzania, thailand, togo, tonga, trinidad and tobago, tunisia, turkey, turkmenistan, tuvalu, uganda, ukraine, united arab emirates, united kingdom, united states, uruguay, uzbekistan, vanuatu, vatican city, venezuela, vietnam, yemen, zambia, zimbabwe",
    "capitals": "abu dhabi, abuja, accra, addis ababa, algiers, amman, amsterdam, ankara, antananarivo, ashgabat, asmara, astana, asuncion, athens, baghdad, baku, bamako, bangkok, bangui, banjul, beijing, beirut, belgrade, belmopan, berlin, bern, bishkek, bissau, bogota, brasilia, bratislava, brazzaville, bridgetown, brussels, bucharest, budapest, buenos aires, cairo, canberra, caracas, castries, chisinau, colombo, conakry, copenhagen, dakar, damascus, dhaka, dili, djibouti, dodoma, doha, dublin, dushanbe, freetown, funafuti, gaborone, georgetown, gitega, guatemala city, hanoi, harare, havana, helsinki, honiara, islamabad, jakarta, jerusalem, juba, kabul, kampala, kathmandu, khartoum, kigali, kingston, kinshasa, kuala lumpur, kuwait city, kyiv, libreville, lilongwe, lima, lisbon, ljubljana, lome, london, luanda, lusaka, luxembourg, madrid, majuro, malabo, male, managua, manama, manila, maputo, maseru, mbabane, mexico city, minsk, mogadishu, monaco, monrovia, montevideo, moroni, moscow, muscat, nairobi, nassau, new delhi, niamey, nicosia, nouakchott, oslo, ottawa, ouagadougou, palikir, panama city, paramaribo, paris, phnom penh, podgorica, port au prince, port louis, port moresby, port of spain, port vila, porto novo, prague, praia, pretoria, pyongyang, quito, rabat, reykjavik, riga, riyadh, rome, roseau, san jose, san marino, san salvador, sanaa, santiago, santo domingo, sao tome, sarajevo, seoul, singapore, skopje, sofia, stockholm, sucre, suva, tallinn, tarawa, tashkent, tbilisi, tegucigalpa, tehran, thimphu, tirana, tokyo, tripoli, tunis, ulaanbaatar, vaduz, valletta, victoria, vienna, vientiane, vilnius, warsaw, washington, wellington, windhoek, yaounde, yerevan, zagreb",
    "elements": "hydrogen, helium, lithium, beryllium, boron, carbon, nitrogen, oxygen, fluorine, neon, sodium, magnesium, aluminium, silicon, phosphorus, sulfur, chlorine, argon, potassium, calcium, scandium, titanium, vanadium, chromium, manganese, iron, cobalt, nickel, copper, zinc, gallium, germanium, arsenic, selenium, bromine, krypton, rubidium, strontium, yttrium, zirconium, niobium, molybdenum, technetium, ruthenium, rhodium, palladium, silver, cadmium, indium, tin, antimony, tellurium, iodine, xenon, caesium, barium, lanthanum, cerium, praseodymium, neodymium, promethium, samarium, europium, gadolinium, terbium, dysprosium, holmium, erbium, thulium, ytterbium, lutetium, hafnium, tantalum, tungsten, rhenium, osmium, iridium, platinum, gold, mercury, thallium, lead, bismuth, polonium, astatine, radon, francium, radium, actinium, thorium, protactinium, uranium, neptunium, plutonium, americium, curium, berkelium, californium, einsteinium, fermium, mendelevium, nobelium, lawrencium, rutherfordium, dubnium, seaborgium, bohrium, hassium, meitnerium, darmstadtium, roentgenium, copernicium, nihonium, flerovium, moscovium, livermorium, tennessine, oganesson",
    "constellations": "andromeda, antlia, apus, aquarius, aquila, ara, aries, auriga, bootes, caelum, camelopardalis, cancer, canes venatici, canis major, canis minor, capricornus, carina, cassiopeia, centaurus, cepheus, cetus, chamaeleon, circinus, columba, coma berenices, corona australis, corona borealis, corvus, crater, crux, cygnus, delphinus, dorado, draco, equuleus, eridanus, fornax, gemini, grus, hercules, horologium, hydra, hydrus, indus, lacerta, leo, leo minor, lepus, libra, lupus, lynx, lyra, mensa, microscopium, monoceros, musca, norma, octans, ophiuchus, orion, pavo, pegasus, perseus, phoenix, pictor, pisces, piscis austrinus, puppis, pyxis, reticulum, sagitta, sagittarius, scorpius, sculptor, scutum, serpens, sextans, taurus, telescopium, triangulum, triangulum australe, tucana, ursa major, ursa minor, vela, virgo, volans, vulpecula",
    "dogbreeds": "affenpinscher, airedale terrier, akita, alaskan malamute, basenji, basset hound, beagle, bernese mountain dog, bichon frise, bloodhound, border collie, borzoi, boston terrier, boxer, briard, bulldog, bullmastiff, cairn terrier, chihuahua, chow chow, cocker spaniel, collie, corgi, dachshund, dalmatian, doberman, foxhound, german shepherd, golden retriever, great dane, greyhound, havanese, irish setter, jack russell terrier, keeshond, komondor, labrador retriever, lhasa apso, maltese, mastiff, newfoundland, papillon, pekingese, pointer, pomeranian, poodle, pug, puli, rottweiler, saint bernard, saluki, samoyed, schnauzer, scottish terrier, shar pei, sheepdog, shiba inu, shih tzu, siberian husky, springer spaniel, vizsla, weimaraner, whippet, yorkshire terrier",
    "herbs": "basil, bay leaf, borage, chervil, chives, coriander, dill, fennel, lavender, lemongrass, marjoram, mint, oregano, parsley, rosemary, sage, savory, sorrel, tarragon, thyme",
    "spices": "allspice, anise, caraway, cardamom, cayenne, cinnamon, cloves, cumin, fenugreek, ginger, mace, mustard, nutmeg, paprika, pepper, saffron, star anise, sumac, turmeric, vanilla",
    "languages": "afrikaans, albanian, amharic, arabic, armenian, basque, bengali, bulgarian, burmese, cantonese, catalan, croatian, czech, danish, dutch, english, estonian, finnish, french, georgian, german, greek, gujarati, hausa, hebrew, hindi, hungarian, icelandic, igbo, indonesian, irish, italian, japanese, javanese, kannada, khmer, korean, kurdish, lao, latin, latvian, lithuanian, malay, malayalam, mandarin, marathi, mongolian, nepali, norwegian, persian, polish, portuguese, punjabi, romanian, russian, serbian, sinhala, slovak, slovenian, somali, spanish, swahili, swedish, tagalog, tamil, telugu, thai, tibetan, turkish, ukrainian, urdu, uzbek, vietnamese, welsh, yiddish, yoruba, zulu",
    "instruments": "accordion, bagpipes, banjo, bass, bassoon, bell, bongo, bugle, castanets, celesta, cello, clarinet, cornet, cymbals, drum, dulcimer, fiddle, flugelhorn, flute, french horn, glockenspiel, gong, guitar, harmonica, harp, harpsichord, horn, kazoo, lute, lyre, mandolin, maracas, marimba, oboe, organ, piano, piccolo, recorder, saxophone, sitar, tambourine, timpani, triangle, trombone, trumpet, tuba, ukulele, vibraphone, viola, violin, xylophone, zither",
}
LISTS = {name: entries.split(", ") for name, entries in _COMMAS.items()}

#: Other names, by list.
_OTHER = {
    "countries": "country nations nation", "usstates": "states state", "capitals": "capital", "elements": "element", "constellations": "constellation",
    "presidents": "president presidentsurnames", "greekgods": "god gods greekgod", "norsegods": "norsegod", "egyptiangods": "egyptian egyptiangod",
    "dogbreeds": "dogs dog breed breeds", "moons": "moon", "gemstones": "gem gems gemstone", "birthstones": "birthstone", "oceans": "ocean",
    "continents": "continent", "muses": "muse", "sins": "sin deadlysins", "dwarfs": "dwarves sevendwarfs", "bible": "books biblebooks",
    "shakespeare": "plays shakespeareplays", "tarot": "majorarcana", "chinesezodiac": "zodiacchinese", "greek": "greekletters", "nato": "natoalphabet",
    "chesspieces": "chess", "days": "weekdays", "suits": "cardsuits", "compass": "directions", "rainbow": "roygbiv rainbowcolors", "colors": "color colour colours",
    "resistors": "resistor resistorcolors", "reindeer": "reindeers santasreindeer", "cluesuspects": "suspects cluedosuspects", "clueweapons": "weapons cluedoweapons",
    "cluerooms": "rooms cluedorooms", "monopoly": "monopolyproperties monopolysquares", "wonders": "sevenwonders ancientwonders wonder", "apostles": "apostle disciples",
    "knights": "knight roundtable arthurianknights", "virtues": "virtue sevenvirtues heavenlyvirtues", "hogwarts": "hogwartshouses houses", "solfege": "solfa notes",
    "mohs": "mohsscale hardness", "siprefixes": "prefixes metricprefixes siprefix", "anniversaries": "anniversary anniversarygifts weddinganniversaries",
    "dwarfplanets": "dwarfplanet", "nbateams": "nba basketballteams", "nflteams": "nfl footballteams", "mlbteams": "mlb baseballteams", "nhlteams": "nhl hockeyteams",
}
ALIASES = {other: name for name, others in _OTHER.items() for other in others.split()}
