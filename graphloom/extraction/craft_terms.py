"""Vocabularies of the craft detector. All are fixed values: what is found depends on them."""

#: Prefixes of aircraft registrations and the country of each register.
REGISTERS = {
    "N": "United States", "G": "United Kingdom", "M": "Isle of Man", "2": "United Kingdom", "EI": "Ireland", "F": "France", "D": "Germany",
    "OO": "Belgium", "PH": "Netherlands", "OE": "Austria", "HB": "Switzerland", "I": "Italy", "EC": "Spain", "CS": "Portugal", "SX": "Greece",
    "LZ": "Bulgaria", "HA": "Hungary", "SP": "Poland", "OK": "Czech Republic", "OM": "Slovakia", "SE": "Sweden", "LN": "Norway", "OH": "Finland",
    "OY": "Denmark", "TF": "Iceland", "ES": "Estonia", "YL": "Latvia", "LY": "Serbia", "9H": "Malta", "VP-C": "Cayman Islands", "VP-B": "Bermuda",
    "VQ-B": "Bermuda", "T7": "San Marino", "T8": "Palau", "P4": "Aruba", "A6": "United Arab Emirates", "A7": "Qatar", "A9C": "Bahrain", "A4O": "Oman",
    "HZ": "Saudi Arabia", "JY": "Jordan", "OD": "Lebanon", "YK": "Syria", "EP": "Iran", "TC": "Turkey", "4L": "Georgia", "RA": "Russia", "RF": "Russia",
    "UR": "Ukraine", "EW": "Belarus", "UP": "Kazakhstan", "EK": "Armenia", "4K": "Azerbaijan", "EY": "Tajikistan", "EX": "Kyrgyzstan", "C-F": "Canada",
    "C-G": "Canada", "XA": "Mexico", "XB": "Mexico", "XC": "Mexico", "HK": "Colombia", "YV": "Venezuela", "PP": "Brazil", "PR": "Brazil", "PS": "Brazil",
    "PT": "Brazil", "LV": "Argentina", "LU": "Argentina", "CC": "Chile", "OB": "Peru", "CP": "Bolivia", "ZK": "New Zealand", "VH": "Australia",
    "9V": "Singapore", "B": "China", "VT": "India", "PK": "Indonesia", "9M": "Malaysia", "RP": "Philippines", "HS": "Thailand", "VN": "Nepal",
    "S2": "Bangladesh", "AP": "Pakistan", "5Y": "Kenya", "5H": "Tanzania", "ZS": "South Africa", "5N": "Nigeria", "9A": "Croatia",
    "E7": "Bosnia and Herzegovina", "Z3": "North Macedonia", "J5": "Guinea-Bissau", "3DC": "Equatorial Guinea", "3X": "Guinea", "TR": "Gabon",
    "TJ": "Cameroon", "5V": "Togo", "6V": "Senegal", "6W": "Senegal", "5U": "Niger", "XT": "Burkina Faso", "TU": "Ivory Coast", "3B": "Mauritius",
    "D2": "Angola", "9Q": "Democratic Republic of the Congo", "7Q": "Malawi", "Z": "Zimbabwe",
}
#: One-letter prefixes that are believed in running text.
SINGLE_PREFIXES = frozenset("G M F D I B N Z V T U X Y H E L O P S".split())
#: Four-letter words that stand behind a letter and a hyphen without being a registration.
TAIL_WORDS = frozenset(
    "CALL CARD CARE CASE CENT CITY CLUB CODE COME CORE CORP DATA DATE DEAL DEPT DOOR EAST EDGE EURO FACE FILE FILM FINE FIRE FIRM FLAG FOOD FORM GAME "
    "GATE GIRL GOLD HAND HARD HEAD HELP HIGH HOME HOPE INFO ITEM JUST KING LAND LIFE LINE LINK LIST LIVE LOOK MADE MAIL MAIN MAKE MARK MASS MEET MIND "
    "MODE MOON NAME NEWS NEXT NOTE NOVA OPEN PARK PART PLAN PLAY PORT POST RATE REAL RING RISE ROAD ROCK RULE SAFE SAGE SALE SAVE SHIP SHOP SHOW SIDE "
    "SIGN SITE SIZE SOFT SPOT STAR STEP STOP TEAM TECH TELE TIME TOWN TRIP TRUE TYPE UNIT VIEW WALL WAVE WEEK WEST WIDE WILD WIND WINE WING WIRE WISE "
    "WOLF WOND YEAR YORK ZONE".split()
)
#: Two-character airline codes.
AIRLINES = frozenset(
    "AA AB AC AD AE AF AI AK AM AR AS AT AV AY AZ B2 B6 B7 BA BD BG BI BJ BL BP BR BT BX CA CI CL CM CO CX CY CZ DL DP DT DY E2 EA EI EK EN ET EW EY EZ "
    "F7 F9 FB FI FJ FM FR FV FZ G3 GA GE GF GH HA HF HM HR HU HX HY IB IC IE IG IK IR JJ JL JM JO JP JU JX K6 KC KE KL KM KN KP KQ KU KX LA LG LH LO LP "
    "LX LY M3 MH MK MM MS MU NF NH NI NK NO NZ OA OK OM OS OU OZ PC PG PK PM PR PS PX PZ QF QH QR QS QZ RA RB RJ RO SU SV SW SY TC TG TK TM TN TP TU TX "
    "TZ UA U2 U6 U7 U8 UI UL UM UT UU UX VF VI VN VR VS VY W5 W6 W9 WF WS WY X3 X7 XQ Y4 YK YP YU ZB ZH ZL 3K 3O 3U 4U 5J 5K 5N 5W 6H 7H 8U 9C 9U 9V A3 "
    "A5 A9 A4 B0 B3 B4 B5 B8 B9 C4 C5 C6 C7 C8 C9 CC CG D7 D3 D8 D9 E5 4Z 4M 3V 2P 2J".split()
)
#: What reads like a flight number and is a model or a product.
NOT_FLIGHTS = frozenset(
    "A380 A350 A340 A330 A321 A320 A319 A318 A220 A310 A300 A130 A140 A150 A160 A170 A180 A190 B737 B747 B757 B767 B777 B787 B707 B717 B727 B720 B730 "
    "B740 B750 B760 B770 B780 B790 C130 C135 C145 C150 C160 C170 C180 C190 D810 D812 E135 E145 E170 E175 E190 E195 F100 F145 F170 F190 PS4 PS5 PS6 "
    "X360 X750 MD11 MD80 MD90 Q400 Q500 A100 H145 H160 S76 S92 U60 M17 M18".split()
)
#: Prefixes of ships' names.
SHIP_PREFIXES = "MV M/V M-V MT M/T M-T MS M/S SS S.S. SV S/V RV R/V R-V FV F/V MY M/Y M-Y HSC HSV NV TS PS RMS USS HMS".split()
#: Names behind such a prefix that are software: always, together only, and with any other word.
PRODUCTS = frozenset("WINDOWS OFFICE WORD EXCEL OUTLOOK TEAMS XBOX PLAYSTATION ANDROID IOS LINUX DOS UNIX CHROME SAFARI FIREFOX OPERA VISTA SQL AZURE KUBERNETES".split())
PRODUCT_PHRASES = frozenset("ENTERPRISE SERVER SYSTEMS SOLUTIONS TECHNOLOGIES SOFTWARE NETWORK DIGITAL ONLINE GLOBAL PROFESSIONAL EDGE PLATFORM SERVICES CLOUD".split())
PRODUCT_SIGNS = frozenset("SOFTWARE SYSTEMS SOLUTIONS TECHNOLOGIES PLATFORM CLOUD SERVICES SERVER EDITION SUITE LICENCE LICENSE INSTALL UPDATE DATABASE".split())
#: Types of aircraft, ships and ground craft.
AIRCRAFT_TYPES = (
    "Gulfstream G650|Gulfstream G550|Gulfstream G450|Gulfstream G280|Gulfstream G200|Bombardier Global 7500|Bombardier Global 6000|Bombardier Global 5000|"
    "Bombardier Challenger 650|Bombardier Challenger 605|Bombardier Challenger 850|Bombardier Learjet 60|Bombardier Learjet 45|Dassault Falcon 900|"
    "Dassault Falcon 7X|Dassault Falcon 8X|Dassault Falcon 2000|Embraer Legacy 600|Embraer Legacy 450|Embraer Phenom 300|Embraer Praetor 600|"
    "Embraer Lineage 1000|Cessna Citation X|Cessna Citation Latitude|Cessna Citation Sovereign|Cessna Citation Mustang|Hawker 800XP|Beechcraft King Air 350|"
    "Piaggio Avanti|Boeing 737|Boeing 737 MAX|Boeing 737 MAX 8|Boeing 747|Boeing 747-400|Boeing 747-8|Boeing 757|Boeing 767|Boeing 777|Boeing 777-300ER|"
    "Boeing 787|Boeing 787 Dreamliner|Boeing 787-8|Boeing 787-9|Boeing 737-800|Airbus A319|Airbus A320|Airbus A320neo|Airbus A321|Airbus A321neo|Airbus A330|"
    "Airbus A340|Airbus A350|Airbus A380|Airbus A220|Airbus ACJ320|Antonov An-124|Antonov An-225|Antonov An-26|Antonov An-72|Antonov An-148|Ilyushin Il-76|"
    "Ilyushin Il-96|Ilyushin Il-62|Ilyushin Il-18|Tupolev Tu-134|Tupolev Tu-154|Tupolev Tu-204|Tupolev Tu-214|Yakovlev Yak-40|Yakovlev Yak-42|"
    "Sukhoi Superjet 100|Sukhoi Superjet|Embraer ERJ-145|Embraer E190|Embraer E195|ATR 72|ATR 42|De Havilland Dash 8|Bombardier CRJ-900|Bombardier Q400|"
    "Fokker 100|McDonnell Douglas MD-11|MD-80|Lockheed Martin C-130|C-130 Hercules|Boeing C-17|Boeing 707|Ilyushin Il-112|Sikorsky S-76|Sikorsky S-92|"
    "Sikorsky UH-60|Sikorsky Black Hawk|Bell 407|Bell 429|Bell 206|Bell V-22 Osprey|Eurocopter EC135|Eurocopter EC145|Airbus Helicopters H145|"
    "AgustaWestland AW139|Agusta A109|Mil Mi-8|Mil Mi-17|Mil Mi-24|Mil Mi-26|Kamov Ka-32|Kamov Ka-52|Robinson R44|Robinson R66|Leonardo AW169|business jet|"
    "private jet|charter jet|charter flight|cargo plane|cargo aircraft|military transport aircraft|air ambulance|helicopter|drones|unmanned aerial vehicle|"
    "fighter jet|seaplane|turboprop"
).split("|")
SHIP_TYPES = (
    "superyacht|mega yacht|megayacht|motor yacht|sailing yacht|luxury yacht|yacht|VLCC|ULCC|Suezmax tanker|Aframax tanker|crude oil tanker|oil tanker|"
    "product tanker|chemical tanker|LNG carrier|LPG carrier|bulk carrier|container ship|container vessel|ro-ro ferry|cruise ship|cruise liner|"
    "research vessel|icebreaker|cable ship|fishing trawler|trawler|dredger|tugboat|barge|floating crane|semi-submersible|dark fleet tanker|"
    "shadow fleet tanker|shadow fleet vessel"
).split("|")
GROUND_TYPES = (
    "armoured convoy|armored convoy|military convoy|convoy|motorcade|armoured vehicle|armored vehicle|MRAP|Humvee|technical|Toyota Land Cruiser|Land Cruiser|"
    "Toyota Hilux|Hilux pickup|Mercedes-Benz S-Class|Mercedes S600|Maybach|Rolls-Royce Phantom|Bentley Mulsanne|Range Rover|BMW 7 Series|Audi A8|"
    "Cadillac Escalade|Lexus LX|Toyota Century|ZIL limousine|Chaika limousine|Ural truck|KamAZ truck|KamAZ|Ural|armoured train|armored train|"
    "military railway car|BTR-80|BMP-2|BMP-3|T-72|T-90|Leopard 2|Abrams tank|M1 Abrams|S-400 launcher|Iskander launcher|Patriot launcher"
).split("|")
#: Nouns in front of a craft's name, by kind.
NOUNS = {
    "Vessel": "superyacht megayacht yacht vessel tanker ship barge trawler icebreaker ferry cruiser".split(),
    "Aircraft": "aircraft jet airplane aeroplane plane helicopter drone".split(),
    "GroundVehicle": "limousine motorcade convoy".split(),
}
#: Words behind such a noun that are no name.
NOT_NAMES = frozenset(
    "IMO MMSI REGISTRATION REGISTERED NUMBER NO ID IDENT IDENTIFIER TYPE CLASS MODEL NAME NAMED CALLED KNOWN DESIGNATED SERIAL TAIL CALLSIGN FLAG FLAGGED "
    "BUILT OWNED OPERATED CHARTERED UNDER WITH FROM NEAR UNKNOWN UNIDENTIFIED THAT WHICH WAS WERE IS ARE HAD HAS".split()
)
#: The confidence of each kind of match.
CONFIDENCE = {
    "aircraft_registration": 0.95, "imo_number": 0.97, "mmsi": 0.95, "flight_number": 0.7, "vessel_prefixed": 0.9, "aircraft_type": 0.85,
    "vessel_type": 0.8, "ground_craft": 0.75, "craft_appositive": 0.8, "vin": 0.9,
}
