"""Word lists, labels and their order. Results depend on each of them, so they are data and not logic."""

from __future__ import annotations

# Given names and their short forms.
NICKNAMES = {
    "christopher": ["chris"], "elizabeth": ["beth", "liz", "lizzy", "eliza"], "katherine": ["kate", "kathy", "kat", "katie"],
    "catherine": ["cath", "cathy", "cat", "kate"], "william": ["will", "bill", "billy", "liam"], "benjamin": ["ben", "benji"],
    "nicholas": ["nick", "nico"], "alexander": ["alex", "xander"], "matthew": ["matt"], "daniel": ["dan", "danny"],
    "michael": ["mike", "mick", "mikey"], "joseph": ["joe", "joey"], "samuel": ["sam", "sammy"], "thomas": ["tom", "tommy"],
    "james": ["jim", "jimmy", "jamie"], "robert": ["rob", "bob", "bobby", "robbie"], "richard": ["rich", "rick", "dick"],
    "olivia": ["liv", "livy"], "victoria": ["vicky", "tori"], "jennifer": ["jen", "jenny"], "jessica": ["jess", "jessie"],
    "margaret": ["maggie", "meg", "peggy"], "stephanie": ["steph"], "natasha": ["tash", "nat"], "anthony": ["tony", "ant"],
    "andrew": ["andy", "drew"], "jonathan": ["jon", "jonny"], "timothy": ["tim", "timmy"], "rebecca": ["bec", "becca", "beck"],
    "alexandra": ["alex", "lexi"], "jacqueline": ["jackie"], "deborah": ["deb", "debbie"], "susan": ["sue", "suzy"],
    "patricia": ["pat", "patty", "trish"], "phillip": ["phil"], "stephen": ["steve"], "steven": ["steve"], "peter": ["pete"],
    "david": ["dave"], "edward": ["ed", "ted", "teddy"], "frederick": ["fred", "freddy"], "raymond": ["ray"],
    "lawrence": ["larry"], "nathan": ["nate"], "zachary": ["zach", "zac"], "cameron": ["cam"], "harrison": ["harry"],
    "dominic": ["dom"], "mitchell": ["mitch"], "isabella": ["bella", "izzy"], "gabrielle": ["gabby", "gab"],
    "madeline": ["maddy"], "charlotte": ["charlie", "lottie"], "madeleine": ["maddy"], "georgina": ["georgie"],
    "samantha": ["sam"], "abigail": ["abby"], "henrietta": ["henny"], "penelope": ["penny"], "theodore": ["theo"],
    "sebastian": ["seb"], "maximilian": ["max"], "beatrice": ["bea"], "josephine": ["josie"], "francesca": ["fran"],
    "angelina": ["angie"], "veronica": ["ronnie"], "cassandra": ["cass"], "genevieve": ["gen"], "annabelle": ["anna", "belle"],
    "callum": ["cal"], "connor": ["con"], "lachlan": ["lachy"], "declan": ["dec"], "arthur": ["art"], "rupert": ["rupe"],
    "hamish": ["hame"], "angus": ["gus"], "fergus": ["fergie"], "alistair": ["ali"], "bartholomew": ["bart"],
    "barnaby": ["barney"], "reginald": ["reg", "reggie"], "leonard": ["len", "lenny"], "kenneth": ["ken", "kenny"],
    "ronald": ["ron", "ronnie"], "donald": ["don", "donny"], "gerald": ["gerry"], "terence": ["terry"], "stuart": ["stu"],
    "nigel": ["nige"], "katrina": ["kat", "trina"], "melissa": ["mel"], "melanie": ["mel"], "danielle": ["dani"], "monique": ["mon"],
}

# Words that are never a name after a family keyword, nor a nickname to look for.
NOT_NAMES = (
    "dr mr mrs ms miss "
    "dad mum mom mother father brother sister sibling guardian parent partner carer caregiver "
    "nan nana grandmother grandfather grandma grandpa "
    "the and or of in on at to for with from by as "
    "is are was were been be have has had do does did will would should can could may might must shall "
    "art max don pat ray ted rob bob rick dick rich bill sue reg ron len belle penny cam con cal gen dom"
).split()

# Words of organisation names that say nothing on their own.
ORGANISATION_WORDS = (
    "school primary secondary college clinic centre center hospital practice academy institute university department "
    "service services psychology medical health group the and for inc ltd pty"
).split()

# Titles; words before a name; words that show a candidate is no person.
NAME_TITLES = "mr mrs ms miss mx dr prof professor sir madam rev master".split()
HONORIFICS = "mr mrs ms miss mx dr doctor prof professor sir madam".split()
NOT_A_PERSON = (
    "email phone mobile telephone address date birth dob medicare crn ndis abn passport number details signature contact "
    "guardian parent student teacher school report term information assessment"
).split()

# Keywords that a family member's name follows, in this order; they are patterns.
FAMILY_KEYWORDS = [
    "Mother", "Father", "Parent", "Guardian", "Mum", "Dad", "Step-mother", "Step-father", "Step-parent", "Carer", "Caregiver",
    "Emergency Contact", "Next of Kin", "Brother", "Sister", "Sibling", "Partner", "Family member", "Lives with",
    "Referred by parent", "Parent/Guardian signature", "Stepmother", "Stepfather", r"Foster\s+parent", r"Foster\s+carer",
    r"Legal\s+guardian", r"Primary\s+carer", r"Kinship\s+carer", "Aunt", "Uncle", "Grandparent", "Grandmother", "Grandfather",
]
PARENT_HINTS = ["mother", "father", "parent", "mum", "dad", "guardian", "carer", "partner"]

# What replaces a category, what stands for a role, and the order roles are offered in.
CATEGORY_LABELS = {
    "Phone number": "[phone]", "Email address": "[email]", "Address": "[address]", "Date of birth": "[date of birth]",
    "Medicare number": "[Medicare number]", "Student ID": "[student ID]", "Centrelink CRN": "[Centrelink CRN]",
    "NDIS number": "[NDIS number]", "ABN": "[ABN]", "Passport number": "[passport number]", "Location (NER)": "[location]",
    "Date/Time (NER)": "[date]",
}
ROLE_LABELS = {
    "student": "Student", "organisation": "Organisation", "parent": "Parent", "carer": "Carer", "family_member": "Family member",
    "teacher": "Teacher", "school_staff": "School staff", "health": "Health professional", "support_worker": "Support worker",
    "other_student": "Other student", "other": "Other person",
}
ASSIGNABLE_ROLES = ["parent", "carer", "family_member", "teacher", "school_staff", "health", "support_worker", "other_student", "other"]
SHARED_SURNAME, SOME_NAME, SOME_ORGANISATION, SOMETHING = "[Family name]", "[name]", "[organisation]", "[redacted]"
PRIORITIES = {"student": 0, "parent": 1, "family": 2, "organisation": 3, "person": 4}

# Words near a name that speak for a role.
ROLE_KEYWORDS = {
    "parent": ["mother", "mum", "mom", "father", "dad", "parent", "guardian", "stepmother", "stepfather", "step-mother", "step-father"],
    "carer": ["carer", "caregiver", "foster", "kinship", "guardian"],
    "teacher": ["teacher", "classroom teacher", "class teacher", "tutor"],
    "school_staff": ["principal", "deputy", "assistant principal", "aide", "sso", "wellbeing", "coordinator", "integration aide", "chaplain", "counsellor", "counselor", "learning support officer"],
    "health": ["paediatrician", "pediatrician", "psychologist", "psychiatrist", "speech", "pathologist", "occupational therapist", "ot", "physiotherapist", "physio", "gp", "doctor", "clinician", "therapist", "audiologist", "optometrist"],
    "support_worker": ["ndis", "support worker", "social worker", "case manager", "caseworker", "case worker", "advocate", "support coordinator"],
    "other_student": ["classmate", "peer", "fellow student", "another student", "sibling", "brother", "sister"],
}

# Entity types of a name recogniser, the categories they become, and those left out.
ENTITY_CATEGORIES = {
    "PERSON": "Person name (NER)", "LOCATION": "Location (NER)", "GPE": "Location (NER)", "FAC": "Location (NER)", "AU_PHONE": "Phone number",
    "AU_ADDRESS": "Address", "AU_MEDICARE": "Medicare number", "AU_CRN": "Centrelink CRN", "AU_DOB": "Date of birth",
    "STUDENT_NAME": "Student name", "EMAIL_ADDRESS": "Email address", "PHONE_NUMBER": "Phone number", "DATE_TIME": "Date/Time (NER)",
}
ENTITIES_LEFT_OUT = ["LOCATION", "GPE", "FAC", "DATE_TIME"]
ENTITY_THRESHOLD = 0.55

# The names shown for some categories, and recogniser categories that stay chosen for de-identification.
SHOWN_CATEGORIES = {
    "ORGANIZATION (NER)": "Possible organisation (auto-detected)", "NRP (NER)": "Possible group or profession (auto-detected)",
    "Date/Time (NER)": "Date or time (auto-detected)", "Location (NER)": "Possible place name (auto-detected)",
    "Person name (NER)": "Name (found automatically)", "Person name (NER variation)": "Name variation (found automatically)",
}
STAY_CHOSEN = ["Person name (NER)", "Person name (NER variation)", "Location (NER)"]
