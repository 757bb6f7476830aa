"""Schemas of the archive's tables, as DDL; nothing is inferred."""

SEGMENT = "struct<text: string, start: double, end: double>"
PERSON = "struct<name: string, nationality: string>"
CREW_MEMBER = "struct<ev: int, name: string, nationality: string>"

AVAILABLE_DATE = "date string, youtube boolean, eva boolean"
TRANSCRIPT = "utteranceTime string, filename string, start string, end string, language string, text string, textOriginalLang string"
IMAGE = "ID string, dateTaken string, smallUrl string, largeUrl string"
EPHEMERIS = "epoch timestamp, tle_line1 string, tle_line2 string"
SPACEWALK = f"number string, mission string, missionEvaNum int, crew array<{CREW_MEMBER}>, groundIVcrew array<{PERSON}>, startTime timestamp, endTime timestamp, duration string, description string"
STAY = "name string, nationality string, arrivalDate timestamp, arrivalFlight string, departureDate timestamp, departureFlight string, durationDays string"
EXPEDITION = "expedition int, start string, end string, expeditionBlurb string, patchUrl string"
RECORDING = "startTime string, videoId string, duration int, title string"
UTTERANCE = f"language string, segments array<{SEGMENT}>, origLangSegments array<{SEGMENT}>, filename string, descriptor string, utteranceTime string, model string, modelrunner string, transcriptionServerCreateTime string"
CREW_ROW = f"expedition string, missionPatchUrl string, crew array<{PERSON}>, arrivalDate timestamp, arrivalFlight string, departureDate timestamp, departureFlight string, durationDays string"
CLOCK = "startValue string, startedTimestamp long, running boolean"
PHOTO = "mission string, roll string, frame string, pdate string, ptime string, directory string, filename string, filesize string"
FRAME = "file string, frame_no int, is_speech boolean"
TIMED_TEXT = "pos int, seconds int, channel int, text string"
EVENT = "start_time int, end_time int, summary string"
