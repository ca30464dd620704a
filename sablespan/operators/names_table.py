"""Labelled lines for the name labeller: names stand in brackets.

TRAIN is fitted on, with lines that generated() makes of TEMPLATES and name parts. KEPT is held back: it was written in one go and measured
three times: with the features, with more generated lines, and with names at the ends of lines; it shares no name with the others.
"""

from __future__ import annotations

TRAIN = """
[Maria Lind] joined the team in March.
Please contact [Peter Okafor] at the front desk.
Dear Ms. [Larsen], thank you for your letter.
Dr. [Ruth Adeyemi] signed the report on Monday.
The report was signed by [Hans Meyer] and [Julia Braun].
Best regards, [Tom]
My name is [Sofia Rossi] and I live in Milan.
I spoke with [Ahmed] yesterday about the invoice.
Interviewer: [Chen Wei], Senior Engineer
Patient [Laura Novak] was seen in the clinic.
[J. R. Whitfield] wrote the first draft.
[O'Brien] called twice about the Harbor Street house.
The committee thanked [Anne-Marie Dubois] for her work.
Manager: [Kwame Mensah]
Employee name: [Lucia Fernandez]
cc: [Mark Stone], [Elena Petrova]
Met [Jonas] and his sister [Clara] at the station.
Yours sincerely, [Henrik Dahl]
Professor [Ivan Horvat] teaches Linear Algebra.
Mr [Smith] lives next door.
Mrs. [Green] has moved to Oslo.
The award went to [Grace Hopperton] in Boston.
Written by [Emeka Obi] for the Daily News.
[Fatima Zahra] studied at Lakeside College.
Ask [Bob] for the key.
Thanks, [Priya]
Reviewed by [David Cohen], Ohio State University.
Sincerely [Yuki Tanaka]
Nurse [Olga Ivanova] checked the ward.
According to [Miguel Santos], the bridge is closed.
Her brother [Daniel] works at Northfield Bank.
Sales Manager [Ingrid Olsen] opened the meeting.
The meeting starts on Tuesday in Room Seven.
She studied at Lakeside Training Center in Dayton.
New York and Los Angeles are far apart.
Python and Java are used in the Data Platform team.
Senior Software Engineer, Cloud Platform
University of Oslo, Department of Physics
The Harbor Street office opens in January.
Bachelor of Science in Computer Science
United States Department of Labor
Work Experience
Our product is sold in Germany, France and Spain.
Managed the Green Energy project for North Power.
Microsoft Office and Google Docs
The Red Cross opened a Health Center in Nairobi.
Suite 5, Lake Erie Shore, Ohio
Yesterday the Board of Directors met in Vienna.
Please send it to the Human Resources office.
He works for Blue River Systems as a Project Lead.
Monday and Friday are free.
Thank you for your interest in Summit Bank.
Hindu Students Association, Spring Festival
Class of 2021, Dean's List
Deployed with Docker on Amazon servers.
This is the House of Lords.
Winter Street, West Harbor Avenue
Summary of Qualifications
""".strip().splitlines()

KEPT = """
The letter came from [Beatriz Almeida] in Lisbon.
Call [Rashid] before noon.
Dear Mr. [Kowalczyk], your order has shipped.
Signed, [Nadia Haddad]
[Liam Gallagher-Reed] plays on Saturday.
Supervisor: [Tunde Bakare]
I met [Astrid] at Central Station.
Project lead [Mei Lin] presented the Atlas Roadmap.
Dr. [Paulo Teixeira] and nurse [Hanna Virtanen] were on duty.
The house belongs to [Gustav Eklund].
According to [R. K. Narang], prices will rise.
Our guest was [Imani] from Kenya.
My name is [Stefan Vogel].
Kind regards, [Chiara]
Invoice for [Noor Rahman], Maple Avenue 12
She thanked [Oksana Bondar] and the Fire Department.
[Viktor] sold his car to [Salma Idris].
Patient: [Wanda Zielinska]
The author, [Dmitri Volkov], lives in Riga.
Please forward this to [Abena Owusu].
Mrs. [Thornbury] keeps bees.
Reported by [Kenji Mori] on Thursday.
Her teacher was [Leonie Fischer] at Hilltop School.
His son [Mateo] is five.
The Grand Canyon is in Arizona.
Education and Training
She works at Pacific Gas in San Diego.
Certified Public Accountant, State of Texas
Version Two of the Data Model is ready.
The Ministry of Health opened an office in Geneva.
Skills: Excel, Tableau, Power Point
Summer Camp starts in August.
Regional Sales Director, Western Europe
The Baltic Sea was calm on Sunday.
Master of Arts, King's College London
Terms and Conditions apply to Silver Members.
""".strip().splitlines()

#: Parts of generated lines; a template's {n} is a name.
TEMPLATES = """
Dear {n}, please find the plan enclosed.
I talked to {n} about the budget.
{n} will lead the Spring Campaign.
Prepared by {n}, Finance Department
Contact: {n}
Name: {n}
Mr. {n} and the Sales Team met in Berlin.
Regards, {n}
The nurse called {n} on Monday morning.
We hired {n} from Lakeside University.
Interview with {n} at Blue Harbor Inc.
was sent to {n} in Madrid.
Her name is {n}.
The letter is from {n}.
Today we met {n}.
""".strip().splitlines()
FIRST = "Anna Carl Erik Omar Lena Paul Nina Jose Mary Ali Eva John Sara Igor Leila Sven Rosa Ben Kofi Jane".split()
LAST = "Berg Holm Diaz Khan Weber Jones Silva Novotny Baker Singh Moreau Costa Ito Nilsson Carter Bauer Osei Rivera Nowak Hughes".split()


#: Lines without names; {t} is a term of one to three parts, by turns.
OTHERS = """
The {t} is in Denver.
{t}
She moved from Prague to {t} in June.
{t}: Planning, Review
He works at {t} as an analyst.
We use {t} and {t} every day.
{t} opens on Wednesday.
Experience in {t}
{t} of Hamburg, {t}
Our {t} was closed last Friday.
Skills and {t}
In April the {t} will meet.
""".strip().splitlines()
TERMS = "Marine Office Data Budget Council Central Design School Market Quality Bridge Report Southern Library Systems Energy River Network Tower Review Museum Bank Manager Project Institute Lake Forum Club Plan Service".split()
#: Syllables of invented names, so that the fit leans on what is around a name and not on its letters.
SYLLABLES = "ba ri to ne lu ka sha mi do ve an el or is um jo zi ha we pe".split()


def _invented(k: int) -> str:
    """A name of two or three syllables, another for every k."""
    parts = [SYLLABLES[(k * step + shift) % len(SYLLABLES)] for step, shift in ((7, 0), (3, k // 20), (11, k // 7))]
    return "".join(parts[: 2 + k % 2]).capitalize()


def generated() -> list[str]:
    """Every template with names and terms by turns: known and invented parts, whole, first only, and with an initial."""
    out = []
    for i, template in enumerate(TEMPLATES):
        for j, known in enumerate(FIRST):
            k = i * len(FIRST) + j
            first, last = (known, LAST[(i + j) % len(LAST)]) if k % 3 == 0 else (_invented(k), _invented(k + 500))
            name = (f"{first} {last}", first, f"{first} {first[0]}. {last}", last)[(i + j) % 4]
            out.append(template.replace("{n}", f"[{name}]"))
    for i, template in enumerate(OTHERS):
        for j in range(12):
            k = i * 12 + j
            term = " ".join(TERMS[(k * step + j) % len(TERMS)] for step in (1, 7, 13)[: 1 + k % 3])
            out.append(template.replace("{t}", term))
    return out
