"""Sentences written by hand for the test of the finder: ``(text, {(kind, found_text), ...})``.

None of them takes its wording from the test tables.
"""

N, P, E, I, A = "person_name", "phone", "email", "id_number", "address"

HELD_OUT = [
    ("My colleague Priya Fernando joined the call late.", {(N, "Priya Fernando")}),
    ("Interviewer: Jonas Weber", {(N, "Jonas Weber")}),
    ("The hiring manager, Mei Ling Tan, will decide on Thursday.", {(N, "Mei Ling Tan")}),
    ("Cc: Amara Okafor", {(N, "Amara Okafor")}),
    ("José Álvarez wrote that the offer still stands.", {(N, "José Álvarez")}),
    ("Please forward this to Mr Henry Osei before noon.", {(N, "Henry Osei")}),
    ("Our recruiter Chloé Dubois has your file.", {(N, "Chloé Dubois")}),
    ("Yesterday Tomasz Kowalski presented the migration plan to the board.", {(N, "Tomasz Kowalski")}),
    ("Name: Lakshmi Narayanan\nPosition: analyst", {(N, "Lakshmi Narayanan")}),
    ("Minutes taken by, and signed by Oluwaseun Adeyemi.", {(N, "Oluwaseun Adeyemi")}),
    ("According to Fatima Zahra, the visa was refused twice.", {(N, "Fatima Zahra")}),
    ("Hi Gwendolyn,\nthe contract is attached.\nBest wishes,\nRupert", {(N, "Gwendolyn"), (N, "Rupert")}),
    ("Good news from Ms. Adler: Adler has approved the budget.", {(N, "Adler")}),
    ("I met with Dr. Siobhan Kelly, our new head of data.", {(N, "Siobhan Kelly")}),
    ("Kenji Nakamura (born 1984) applied in March.", {(N, "Kenji Nakamura")}),
    ("Emergency contact: Beatriz Souza, +55 11 91234-5678", {(N, "Beatriz Souza"), (P, "+55 11 91234-5678")}),
    ("The author Ingrid van der Meer lives abroad.", {(N, "Ingrid van der Meer")}),
    ("She reports to Nadia Petrova and manages nobody.", {(N, "Nadia Petrova")}),
    ("Applicant O'Connor, Maeve\nApplied 4 May", {(N, "O'Connor, Maeve")}),
    ("We were introduced by Samuel Mbeki last year.", {(N, "Samuel Mbeki")}),
    ("Ahmad bin Yusof confirmed his start date.", {(N, "Ahmad bin Yusof")}),
    ("Referee: Prof. Margaret Liu\nmliu@uni.example", {(N, "Margaret Liu"), (E, "mliu@uni.example")}),
    ("Her mother Esther Wanjiru called twice.", {(N, "Esther Wanjiru")}),
    ("Thanks to Pavel Novak the backlog is gone.", {(N, "Pavel Novak")}),
    ("Spoken to Xin Yi Lim on Friday; Xin Yi prefers mornings.", {(N, "Xin Yi Lim"), (N, "Xin Yi")}),
    ("Attn: Carlos Mendes\nRua das Flores 120, 4050-262 Porto", {(N, "Carlos Mendes"), (A, "Rua das Flores 120, 4050-262 Porto")}),
    ("Invoices go to 12 Rue de la Paix, 75002 Paris every month.", {(A, "12 Rue de la Paix, 75002 Paris")}),
    ("The office moved to 221B Baker Street, London NW1 6XE.", {(A, "221B Baker Street, London NW1 6XE")}),
    ("Home address: Via Garibaldi 7, 20121 Milano", {(A, "Via Garibaldi 7, 20121 Milano")}),
    ("Deliver it to 1600 Elm Avenue, Springfield IL 62704, please.", {(A, "1600 Elm Avenue, Springfield IL 62704")}),
    ("He lives in Flat 3, 18 Rosebery Terrace, Leith EH6 5QU now.", {(A, "Flat 3, 18 Rosebery Terrace, Leith EH6 5QU")}),
    ("Visit us: Gartenstraße 15, 79098 Freiburg", {(A, "Gartenstraße 15, 79098 Freiburg")}),
    ("Calle Mayor 45, 28013 Madrid is the registered seat.", {(A, "Calle Mayor 45, 28013 Madrid")}),
    ("Unit 5, 77 Flinders Lane, Melbourne VIC 3000", {(A, "Unit 5, 77 Flinders Lane, Melbourne VIC 3000")}),
    ("You may ring 020 7946 0018 after six.", {(P, "020 7946 0018")}),
    ("Whatsapp: 98123 45678", {(P, "98123 45678")}),
    ("Dial (212) 555-0147 and press 2.", {(P, "(212) 555-0147")}),
    ("My new cell is +1 (415) 555-0132.", {(P, "+1 (415) 555-0132")}),
    ("Fax 03-5555 0199 is switched off.", {(P, "03-5555 0199")}),
    ("Write to lena.m@firma.example or lena(at)home(dot)example.", {(E, "lena.m@firma.example"), (E, "lena(at)home(dot)example")}),
    ("mailto:hr-team@jobs.example?subject=cv", {(E, "hr-team@jobs.example")}),
    ("CPF 529.982.247-25 was checked.", {(I, "529.982.247-25")}),
    ("The number 529.982.247-25 stood on the form.", {(I, "529.982.247-25")}),
    ("Passport number: K04918273", {(I, "K04918273")}),
    ("Her social security number is 219-09-9999.", {(I, "219-09-9999")}),
    ("NRIC no. S1234567D on file.", {(I, "S1234567D")}),
    ("Only S1234567D was written there.", {(I, "S1234567D")}),
    ("DNI: 12345678Z", {(I, "12345678Z")}),
    ("Driving licence MORGA657054SM9IJ expired.", {(I, "MORGA657054SM9IJ")}),
    ("Aadhaar 2341 2341 2346 was uploaded.", {(I, "2341 2341 2346")}),
]

#: Texts with nothing personal in them, though it looks like it.
NOTHING = [
    "Siemens Energy and Delta Analytics opened an office in San Francisco.",
    "The Data Platform team uses Apache Spark and Google Cloud.",
    "Order 4500123456 was shipped on 12 March 2024 in 3 boxes.",
    "Version 10.2.34 fixes row 123456789 of build 20240311.",
    "We meet in Conference Room Alpha near Central Station.",
    "Senior Java Developer, Machine Learning Engineer and Product Owner wanted.",
    "Serial no. S1234567A is not a valid number.",
    "Salary: USD 45,000 - 60,000 per year; grade 12.",
    "Monday Morning Meeting: Quarterly Business Review.",
    "See https://jobs.example/p/0712345678 for details.",
]
