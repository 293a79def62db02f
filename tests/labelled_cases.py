"""A labelled set of our own, one list of (category, text, [(type, span)]) in reading order. All names are made up and all numbers are synthetic."""

import itertools

PEOPLE = {
    "person_north_indian": ["Rohit Malhotra", "Neha Chauhan", "Gaurav Tiwari", "Kavita Rathi", "Vivek Saxena", "Pooja Dubey", "Manoj Tyagi", "Sunita Vohra"],
    "person_south_indian": ["Lakshmi Subbaiah", "Arun Venkatraman", "Karan Nambiar", "Meena Gopalan", "Naveen Shetty", "Deepa Warrier", "Murali Thangavel", "Kannan Iyengar"],
    "person_muslim": ["Imran Lodhi", "Fatima Rizvi", "Anwar Qadri", "Nadia Hashmi", "Zoya Mirza", "Mohammed Wasti"],
    "person_christian": ["Thomas Kurian", "Maria Lobo", "Joseph Pinto", "Sarah Chacko", "Agnes Mascarenhas"],
    "person_sikh": ["Gurdeep Bhullar", "Jaspreet Walia", "Simran Sekhon", "Harpal Tiwana", "Navjot Brar"],
    "person_common_word_name": ["Asha Prem", "Kiran Jyoti", "Suman Mala", "Usha Rani", "Daya Ram", "Hope Fernandes", "Roshan Lal", "Moti Shah"],
}
SAID = ["{} signed the lease on Monday.", "The parcel is for {}, second floor.", "Ask {} about the invoice.", "Yesterday {} rang twice.", "We owe {} a reply.", "A letter from {}'s office came."]
HOSTS = ["kite.org", "sub.mango.co.in", "rice-mill.net", "a1.example.io"]
CITIES = ["Pune", "Kochi", "Indore", "Nagpur", "Chennai", "Jaipur", "Mysore", "Patna"]


def rows(valid, bad):
    """valid, bad: twelve-digit numbers that pass the checksum, and that don't."""
    out = []
    for category, names in PEOPLE.items():
        out += [(category, said.format(name), [("PERSON", name)]) for name, said in zip(names, itertools.cycle(SAID))]
    for k, user in enumerate(("olive", "o.live", "olive+bill", "o_live", "OLIVE", "o1", "olive%x", "o-live")):
        out.append(("email", f"Send it to {user}@{HOSTS[k % 4]} today.", [("EMAIL", f"{user}@{HOSTS[k % 4]}")]))
    for k, phone in enumerate(("70123 45678", "7012345678", "+91 70123 45678", "+917512345671", "+91-8012345678", "08012345678", "90123-45678", "06012345678", "60000 00001", "+91 99999-00000")):
        out.append(("phone", f"Line {k} is {phone}, after six.", [("PHONE", phone)]))
    for k, holder in enumerate("ABCFGHJLPT"):
        out.append(("pan", f"Card QWE{holder}R{1000 + k}T was filed.", [("PAN", f"QWE{holder}R{1000 + k}T")]))
    for k, number in enumerate(valid[:10]):
        shown = (number, f"{number[:4]} {number[4:8]} {number[8:]}", f"{number[:4]}-{number[4:8]}-{number[8:]}")[k % 3]
        out.append(("aadhaar", f"Number {shown} was checked.", [("AADHAAR", shown)]))
    out += [("location", f"The depot in {city} opens at nine.", [("LOCATION", city)]) for city in CITIES]
    for k in range(16):
        name, city, number = PEOPLE["person_north_indian"][k % 8], CITIES[k % 8], valid[10 + k % 5]
        mail, card = f"m{k}@{HOSTS[k % 4]}", f"QWEPR{2000 + k}T"
        if k % 2:
            out.append(("mixed", f"{name} of {city} wrote from {mail}.", [("PERSON", name), ("LOCATION", city), ("EMAIL", mail)]))
        else:
            out.append(("mixed", f"{name}: {number}, {card}, 7012345{600 + k}, {mail}", [("PERSON", name), ("AADHAAR", number), ("PAN", card), ("PHONE", f"7012345{600 + k}"), ("EMAIL", mail)]))
    for text in ("The kettle boiled.", "Order 12 of 40 is late.", "Room 101, row 7.", "See page 2024.", "It rained.", "A = b + c", "50 % off", "10:30 to 11:45", "v1.2.3", "No one came.", "x@y", "@here", "Ref 998877", "1,234,567.89"):
        out.append(("negative_no_pii", text, []))
    near = [*bad[:4], "QWEZR1234T", "QWEIR1234T", "qwepr1234t", "QWEPR123T", "5012345678", "70123456789", "a@b.c", "a@-b.com"]
    out += [("near_miss_no_gold", f"Code {x} is none.", []) for x in near]
    for firm in ("Lotus Mills", "Granite Works", "Silver Foods", "Harbour Line", "Union Press", "Copper Bank"):
        out.append(("org_distractor_no_pii", f"{firm} paid the bill.", []))
    return out
