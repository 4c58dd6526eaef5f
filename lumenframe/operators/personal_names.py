"""Fixed values of the personal-data scan: names, tokens and reasons."""

ARTICLE_BASIC = "RGPD Article 4(1)"
ARTICLE_SENSITIVE = "RGPD Article 9"

# Reasons with this beginning fall under the article on sensitive data.
SENSITIVE_PREFIX = "Donnée sensible"

# Whole names that identify a person, with the reason shown.
HIGH_EXACT = {
    "email": "Identifiant personnel — Adresse e-mail",
    "mail": "Identifiant personnel — Adresse e-mail",
    "e_mail": "Identifiant personnel — Adresse e-mail",
    "courriel": "Identifiant personnel — Adresse e-mail",
    "phone": "Identifiant personnel — Numéro de téléphone",
    "telephone": "Identifiant personnel — Numéro de téléphone",
    "tel": "Identifiant personnel — Numéro de téléphone",
    "mobile": "Identifiant personnel — Numéro de mobile",
    "portable": "Identifiant personnel — Numéro de mobile",
    "gsm": "Identifiant personnel — Numéro de mobile",
    "fax": "Identifiant personnel — Numéro de fax",
    "nom": "Identifiant personnel — Nom de famille",
    "prenom": "Identifiant personnel — Prénom",
    "name": "Identifiant personnel — Nom complet",
    "firstname": "Identifiant personnel — Prénom",
    "lastname": "Identifiant personnel — Nom de famille",
    "surname": "Identifiant personnel — Nom de famille",
    "fullname": "Identifiant personnel — Nom complet",
    "full_name": "Identifiant personnel — Nom complet",
    "nom_complet": "Identifiant personnel — Nom complet",
    "adresse": "Identifiant personnel — Adresse postale",
    "address": "Identifiant personnel — Adresse postale",
    "rue": "Identifiant personnel — Rue",
    "street": "Identifiant personnel — Rue",
    "voie": "Identifiant personnel — Voie",
    "ssn": "Identifiant personnel — Numéro de sécurité sociale",
    "nss": "Identifiant personnel — Numéro de sécurité sociale",
    "secu": "Identifiant personnel — Numéro de sécurité sociale",
    "securite_sociale": "Identifiant personnel — Numéro de sécurité sociale",
    "national_id": "Identifiant personnel — Numéro national d'identité",
    "id_national": "Identifiant personnel — Numéro national d'identité",
    "cin": "Identifiant personnel — Carte d'identité nationale",
    "cni": "Identifiant personnel — Carte d'identité nationale",
    "passport": "Identifiant personnel — Numéro de passeport",
    "passeport": "Identifiant personnel — Numéro de passeport",
    "carte_identite": "Identifiant personnel — Carte d'identité",
    "ip": "Identifiant personnel — Adresse IP",
    "ip_address": "Identifiant personnel — Adresse IP",
    "adresse_ip": "Identifiant personnel — Adresse IP",
    "device_id": "Identifiant personnel — Identifiant d'appareil",
    "identifiant_appareil": "Identifiant personnel — Identifiant d'appareil",
    "mac_address": "Identifiant personnel — Adresse MAC",
    "date_naissance": "Identifiant personnel — Date de naissance",
    "dob": "Identifiant personnel — Date de naissance",
    "birthdate": "Identifiant personnel — Date de naissance",
    "birthday": "Identifiant personnel — Date de naissance",
    "naissance": "Identifiant personnel — Date de naissance",
    "birth_date": "Identifiant personnel — Date de naissance",
    "user_id": "Identifiant personnel — Identifiant utilisateur",
    "userid": "Identifiant personnel — Identifiant utilisateur",
    "client_id": "Identifiant personnel — Identifiant client",
    "clientid": "Identifiant personnel — Identifiant client",
    "customer_id": "Identifiant personnel — Identifiant client",
    "customerid": "Identifiant personnel — Identifiant client",
    "patient_id": "Identifiant personnel — Identifiant patient",
    "employee_id": "Identifiant personnel — Identifiant employé",
    "employeeid": "Identifiant personnel — Identifiant employé",
    "matricule": "Identifiant personnel — Matricule",
    "identifiant": "Identifiant personnel — Identifiant",
    "identifier": "Identifiant personnel — Identifiant",
    "login": "Identifiant personnel — Login",
    "username": "Identifiant personnel — Nom d'utilisateur",
    "password": "Identifiant personnel — Mot de passe",
    "mot_de_passe": "Identifiant personnel — Mot de passe",
    "mdp": "Identifiant personnel — Mot de passe",
    "pwd": "Identifiant personnel — Mot de passe",
    "token": "Identifiant personnel — Jeton d'authentification",
    "secret": "Identifiant personnel — Secret",
    "api_key": "Identifiant personnel — Clé API",
    "apikey": "Identifiant personnel — Clé API",
    "iban": "Identifiant personnel — IBAN (données bancaires)",
    "bic": "Identifiant personnel — BIC (données bancaires)",
    "swift": "Identifiant personnel — SWIFT (données bancaires)",
    "compte_bancaire": "Identifiant personnel — Compte bancaire",
    "carte_credit": "Identifiant personnel — Carte de crédit",
    "credit_card": "Identifiant personnel — Carte de crédit",
    "cvv": "Identifiant personnel — CVV (carte bancaire)",
    "pan": "Identifiant personnel — PAN (numéro de carte)",
    "numero_secu": "Identifiant personnel — Numéro de sécurité sociale",
    "numero_client": "Identifiant personnel — Numéro client",
    "numero_employe": "Identifiant personnel — Numéro employé",
}

# Whole names of quasi-identifiers and sensitive data, with the reason shown.
MEDIUM_EXACT = {
    "age": "Quasi-identifiant — Âge",
    "genre": "Quasi-identifiant — Genre",
    "gender": "Quasi-identifiant — Gender",
    "sexe": "Quasi-identifiant — Sexe",
    "sex": "Quasi-identifiant — Sex",
    "ville": "Quasi-identifiant — Ville",
    "city": "Quasi-identifiant — City",
    "commune": "Quasi-identifiant — Commune",
    "municipalite": "Quasi-identifiant — Municipalité",
    "pays": "Quasi-identifiant — Pays",
    "country": "Quasi-identifiant — Country",
    "nation": "Quasi-identifiant — Nation",
    "nationalite": "Quasi-identifiant — Nationalité",
    "nationality": "Quasi-identifiant — Nationality",
    "region": "Quasi-identifiant — Région",
    "departement": "Quasi-identifiant — Département",
    "province": "Quasi-identifiant — Province",
    "code_postal": "Quasi-identifiant — Code postal",
    "zip": "Quasi-identifiant — ZIP code",
    "zipcode": "Quasi-identifiant — ZIP code",
    "postal_code": "Quasi-identifiant — Code postal",
    "cp": "Quasi-identifiant — Code postal",
    "cedex": "Quasi-identifiant — CEDEX",
    "salaire": "Quasi-identifiant — Salaire",
    "salary": "Quasi-identifiant — Salary",
    "wage": "Quasi-identifiant — Wage",
    "remuneration": "Quasi-identifiant — Rémunération",
    "revenus": "Quasi-identifiant — Revenus",
    "income": "Quasi-identifiant — Income",
    "earnings": "Quasi-identifiant — Earnings",
    "revenue_annuel": "Quasi-identifiant — Revenu annuel",
    "religion": "Donnée sensible — Religion",
    "ethnicity": "Donnée sensible — Ethnie",
    "race": "Donnée sensible — Origine raciale",
    "origine": "Donnée sensible — Origine",
    "ethnie": "Donnée sensible — Ethnie",
    "handicap": "Donnée sensible — Handicap",
    "disability": "Donnée sensible — Disability",
    "opinion_politique": "Donnée sensible — Opinion politique",
    "political_view": "Donnée sensible — Political view",
    "orientation_sexuelle": "Donnée sensible — Orientation sexuelle",
    "sexual_orientation": "Donnée sensible — Sexual orientation",
    "sante": "Donnée sensible — Santé",
    "health": "Donnée sensible — Health",
    "medical": "Donnée sensible — Médical",
    "diagnostic": "Donnée sensible — Diagnostic médical",
    "maladie": "Donnée sensible — Maladie",
    "pathologie": "Donnée sensible — Pathologie",
    "traitement": "Donnée sensible — Traitement médical",
    "syndicat": "Donnée sensible — Appartenance syndicale",
    "union_membership": "Donnée sensible — Union membership",
    "latitude": "Quasi-identifiant — Coordonnée géographique",
    "longitude": "Quasi-identifiant — Coordonnée géographique",
    "lat": "Quasi-identifiant — Latitude",
    "lon": "Quasi-identifiant — Longitude",
    "lng": "Quasi-identifiant — Longitude",
    "gps": "Quasi-identifiant — Coordonnée GPS",
    "coordinates": "Quasi-identifiant — Coordonnées",
    "localisation": "Quasi-identifiant — Localisation",
    "location": "Quasi-identifiant — Location",
    "geolocation": "Quasi-identifiant — Géolocalisation",
    "position": "Quasi-identifiant — Position géographique",
}

# Tokens at the end or the beginning of a name.
HIGH_ENDS = ["email", "phone", "name", "id", "nom", "prenom", "adresse", "address"]
HIGH_STARTS = ["email", "phone", "tel", "mob", "user"]
MEDIUM_ENDS = ["age", "city", "zip", "lat", "lon", "salary", "income", "gender", "sex"]
MEDIUM_STARTS = ["age", "city", "zip", "lat", "lon"]

# Tokens that matter anywhere in a name.
SEMANTIC = ["birth", "born", "gender", "sex", "geo", "coord", "location", "salary", "wage", "income"]

# Names on the quick list.
QUICK_KEYS = [
    "email", "e_mail", "courriel", "adresse_email", "adresse_mail", "mail", "email_address", "user_email",
    "contact_email", "telephone", "tel", "mobile", "portable", "phone", "phone_number", "numero_telephone",
    "num_tel", "gsm", "nom", "name", "last_name", "lastname", "surname", "family_name", "prenom", "first_name",
    "firstname", "given_name", "nom_complet", "full_name", "nom_prenom", "prenoms", "adresse", "address", "rue",
    "street", "adresse_postale", "adresse_domicile", "adresse_livraison", "adresse_facturation", "numero_rue",
    "code_postal", "postal_code", "zip", "zip_code", "ville", "city", "commune", "localite", "pays", "country",
    "region", "departement", "nss", "numero_securite_sociale", "securite_sociale", "social_security", "ssn",
    "national_id", "id_national", "numero_national", "numero_identite", "cin", "carte_identite", "cni", "passport",
    "passeport", "numero_passport", "numero_passeport", "permis_conduire", "driver_license", "drivers_license", "ip",
    "ip_address", "adresse_ip", "ipv4", "ipv6", "device_id", "mac_address", "user_agent", "cookie_id",
    "date_naissance", "date_de_naissance", "birthdate", "birth_date", "birthday", "dob", "annee_naissance", "age",
    "genre", "gender", "sexe", "sex", "iban", "bic", "numero_compte", "compte_bancaire", "bank_account",
    "carte_credit", "credit_card", "numero_carte", "card_number", "mot_de_passe", "password", "mdp", "pwd", "secret",
    "token", "access_token", "refresh_token", "api_key", "auth_token", "salaire", "salary", "revenu", "income",
    "remuneration", "religion", "origine_ethnique", "ethnicity", "race", "sante", "health", "medical", "diagnostic",
    "maladie", "biometrie", "biometric", "empreinte", "fingerprint", "gps", "latitude", "longitude", "geolocation",
    "localisation", "user_id", "client_id", "customer_id", "account_id", "identifiant", "username", "login",
    "pseudo", "handle", "photo", "avatar", "image_profil", "profile_picture", "signature", "face_id",
    "orientation_sexuelle", "sexual_orientation", "conviction_politique", "opinion_politique", "political_opinion",
    "appartenance_syndicale", "union_membership", "donnee_genetique", "genetic_data",
]
